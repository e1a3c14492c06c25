"""Checks of a pipeline's configuration, before any job starts.

A configuration is a dict of text values. Its keys and defaults are fixed values of the format.
"""

import re

from sluice.sources.files import DEFAULT_PATTERN, DEFAULT_RETENTION_SECONDS
from sluice.sources.kafka import TOPICS_KEY, parse_topic_threads

PARTS = ("pipeline.source", "pipeline.converter", "pipeline.store", "pipeline.sink")

# Integer keys and their defaults. Keys that size threads and buffers are checked, and unused.
INTEGERS = {
    "source.file.thread.number": 1,
    "source.file.scan.interval.second": 30,
    "source.file.flush.init.delay.second": 60,
    "source.file.flush.interval.second": 60,
    "source.file.retention.second": DEFAULT_RETENTION_SECONDS,
    "source.file.buffer.size": 1024 * 1024,
    "source.file.line.buffer.size": 1024,
    "sink.scribe.server.port": 1466,
    "sink.scribe.batch.size": 100,
    "sink.scribe.max.send.interval": 1000,
    "sink.scribe.buffer.capacity": 1000,
    "sink.scribe.thread.number": 6,
    "sink.scribe.worker.sleep": 60_000,
    "sink.scribe.poll.timeout": 1000,
    "sink.scribe.socket.timeout": 60_000,
    "sink.scribe.retry.time": 3,
}
TEXTS = {"source.file.include.pattern": DEFAULT_PATTERN, "source.file.read.order": "asc"}
BOOLEANS = {"source.file.delete.after.read": False}

REQUIRED = {
    "FileSource": ("source.file.directory", "source.file.category"),
    "KafkaSource": (TOPICS_KEY,),
    "ScribeSink": ("sink.scribe.server.hosts",),
}


def part_name(value: str) -> str:
    """`some.package.KafkaSinkV010` and `KafkaSink` name the same part."""
    return re.sub(r"V\d+$", "", value.strip().rsplit(".", 1)[-1])


def get(conf: dict, key: str):
    """A typed value with its default. Typed values are trimmed; plain texts are not."""
    value = conf.get(key)
    if key in INTEGERS:
        return INTEGERS[key] if value is None else int(value.strip())
    if key in BOOLEANS:
        return BOOLEANS[key] if value is None else value.strip().lower() == "true"
    if key in TEXTS:
        return TEXTS[key] if value is None else value.strip()
    return value


def validate_spec(conf: dict) -> dict[str, str]:
    """Check a configuration and return its part names; errors name the pipeline and the key."""
    name = conf.get("pipeline.name")
    if not name:
        raise ValueError("pipeline.name must be specified")
    for key in PARTS:
        if not conf.get(key):
            raise ValueError(f"{name}: {key} must be specified")
    parts = {key.removeprefix("pipeline."): part_name(conf[key]) for key in PARTS}
    for part in parts.values():
        for key in REQUIRED.get(part, ()):
            if not conf.get(key):
                raise ValueError(f"{name}: {key} must be specified")
    for key in INTEGERS.keys() & conf.keys():
        if not re.fullmatch(r"[+-]?[0-9]+", conf[key].strip()):
            raise ValueError(f"{name}: {key}={conf[key]} is not a whole number")
    if parts["source"] == "FileSource" and get(conf, "source.file.read.order") not in ("asc", "desc"):
        raise ValueError(f"{name}: source.file.read.order should be desc or asc")
    if parts["source"] == "KafkaSource":
        try:
            parse_topic_threads(conf[TOPICS_KEY])
        except ValueError as wrong:
            raise ValueError(f"{name}: {wrong}") from None
    return parts
