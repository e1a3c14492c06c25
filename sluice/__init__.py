"""Collecting, converting, delivering and accounting for log messages with Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from sluice.functions.text import decode_utf8  # noqa: E402,F401
from sluice.operators.batching import assign_batches  # noqa: E402,F401
from sluice.operators.convert import (  # noqa: E402,F401
    add_host_prefix, apply_converter, convert_batches, drop_empty, filter_messages, identity,
    parse_mappings, rename_topics)
from sluice.operators.counters import (  # noqa: E402,F401
    count_by_interval, count_messages, decayed_rates, delivery_alerts, mean_rates, reconcile,
    throughput, write_counters)
from sluice.operators.deadletter import (  # noqa: E402,F401
    discard, load_letters, pending_letters, quarantined_letters, release, replay, replay_due,
    store_failures)
from sluice.operators.lines import (  # noqa: E402,F401
    line_offsets, resume_lines, split_lines, tag_category)
from sluice.operators.snapshots import snapshot_diff  # noqa: E402,F401
from sluice.plans.flow import Pipeline, from_conf, live_rates, start_all  # noqa: E402,F401
from sluice.plans.sources import FileSource, KafkaSource  # noqa: E402,F401
from sluice.plans.spec import validate_spec  # noqa: E402,F401
from sluice.sinks.delivery import (  # noqa: E402,F401
    Delivery, EndpointSink, FileSink, KafkaSink, deliver)
from sluice.sinks.endpoint import (  # noqa: E402,F401
    EndpointOptions, deliver_to_endpoint, endpoint_data_source, write_endpoint)
from sluice.sinks.files import read_messages, stream_files, write_files  # noqa: E402,F401
from sluice.sinks.kafka import (  # noqa: E402,F401
    kafka_sink_options, stream_to_kafka, to_kafka, write_kafka)
from sluice.sources.cleanup import (  # noqa: E402,F401
    delete_files, delete_in_tasks, expire_older_than_days)
from sluice.sources.files import (  # noqa: E402,F401
    list_files, match_files, order_files, plan_groups, read_lines, read_pending, scan_directory,
    split_expired, unfinished_files, unread_files)
from sluice.sources.kafka import (  # noqa: E402,F401
    from_kafka, kafka_source_options, parse_topic_threads, read_kafka, stream_kafka)
from sluice.sources.ledger import (  # noqa: E402,F401
    advance_ledger, backlog, import_text_ledger, ledger_log, load_ledger, save_ledger)
from sluice.sources.ranges import probe_ends, ranges_of, read_ranges  # noqa: E402,F401
from sluice.sources.statelog import StateConflict, StateLog  # noqa: E402,F401
from sluice.streaming.files import stream_lines  # noqa: E402,F401
