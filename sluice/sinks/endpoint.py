"""Delivery of entries to one of several remote hosts, in batches, from the executors.

Spark supplies the partitions; each partition has one sender. The protocol is not part of
this package: a `client_factory(host)` connects (and raises if it cannot) and returns an
object with `send(list of (category, message))` and `close()`. `send` raises on a broken
connection, returns False to be tried again, and anything else for success. A batch that is
refused goes with a later one; see `Sender` for the schedule.

A retried task sends again: delivery is at least once.
"""

import random
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, replace

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage)

# A refused batch keeps its rows in memory; beyond so many Arrow frames it is settled first.
HELD_FRAMES = 16


@dataclass(frozen=True)
class EndpointOptions:
    """`retries` bounds the tries of a batch and the rounds over hosts that are all down.

    A partition waits `wait_budget_ms` in total at most, whatever it waits for. Up to `queue_entries` refused
    entries are kept for later. A host that refuses `breaker_refusals` new batches in a row is left alone for a while.
    """
    hosts: tuple[str, ...]
    batch_size: int = 100
    max_interval_ms: int = 1000
    retries: int = 3
    all_down_wait_ms: int = 60_000
    try_later_wait_ms: int = 100
    wait_budget_ms: int = 120_000
    queue_entries: int = 1000
    breaker_refusals: int = 10


class _Batch:
    """Entries on their way, and whom to tell what became of them."""

    def __init__(self, entries, settled):
        self.entries, self.settled = entries, settled
        self.tries, self.due, self.accepted = 0, 0.0, 0


class _Host:
    """The breaker of a host: refusals in a row, and until when it is left alone."""

    def __init__(self):
        self.refusals, self.opened, self.until = 0, 0, 0.0


class Sender:
    """Sends batches, keeps refused ones for later, and fails over. `seed` fixes the choice of hosts.

    A refused batch is queued and new ones go on. It is tried again when its pause (doubled each time) is over, or
    as soon as a host has accepted a later batch, as then the hosts are not busy. Only a full queue or the end of the
    entries makes the sender wait. Once the partition's budget of waiting is used up, what is left gets
    its tries at once, so that a partition ends.

    When no host accepts a connection after `retries` rounds, the sender gives up: all further
    batches of the partition fail at once.
    """

    def __init__(self, client_factory: Callable, options: EndpointOptions, seed: int = 0):
        self.factory, self.options = client_factory, options
        self.random = random.Random(seed)
        self.hosts, self.client, self.host = list(options.hosts), None, None
        self.state = {host: _Host() for host in options.hosts}
        self.unsent, self.refused, self.queued = deque(), deque(), 0
        self.accepted, self.waited, self.ahead = 0, 0.0, 0.0
        self.given_up = None

    def now(self) -> float:
        return time.monotonic() + self.ahead

    def wait(self, until: float) -> None:
        """Sleep, as far as the budget goes. What it does not cover counts as waited."""
        seconds = min(until - self.now(), self.options.wait_budget_ms / 1000 - self.waited)
        if seconds > 0:
            self.waited += seconds
            time.sleep(seconds)
        self.ahead += max(0.0, until - self.now())

    def pause(self, times: int) -> float:
        """Doubled with each time, and never longer than the wait for hosts that are down."""
        longest = max(self.options.all_down_wait_ms, self.options.try_later_wait_ms)
        return min(self.options.try_later_wait_ms * 2 ** min(times, 30), longest) / 1000

    def available(self) -> bool:
        """False while all hosts that are not known to be down are left alone."""
        return self.client is not None or not self.hosts or self.given_up is not None or any(
            self.state[host].until <= self.now() for host in self.hosts)

    def connect(self) -> None:
        """Try hosts at random. When all have failed, wait and start over, `retries` times."""
        for attempt in range(self.options.retries):
            while self.hosts:
                ready = [host for host in self.hosts if self.state[host].until <= self.now()]
                if not ready:
                    self.wait(min(self.state[host].until for host in self.hosts))
                    continue
                self.host = self.random.choice(ready)
                try:
                    self.client = self.factory(self.host)
                    return
                except Exception as failure:
                    reason = failure
                    self.hosts.remove(self.host)
            self.hosts = list(self.options.hosts)
            if attempt + 1 < self.options.retries:
                self.wait(self.now() + self.options.all_down_wait_ms / 1000)
        raise ConnectionError(f"no host accepts a connection: {reason!r}")

    def drop(self, exclude: bool) -> None:
        """Leave the host, and do not choose it again until another one has worked."""
        self.close()
        if exclude and self.host in self.hosts:
            self.hosts.remove(self.host)

    def offer(self, batch: list, settled: Callable[[str | None], None]) -> None:
        """Send a batch now or later; `settled` is told None, or the reason why it could not be sent."""
        self.unsent.append(_Batch(batch, settled))
        self.queued += len(batch)
        self.work(self.options.queue_entries)

    def flush(self) -> None:
        """Settle all that is queued."""
        self.work(0)

    def send(self, batch: list) -> str | None:
        """Send one batch to the end; returns None, or the reason why it could not be sent."""
        outcome = []
        self.offer(batch, outcome.append)
        self.flush()
        return outcome[0]

    def work(self, limit: int) -> None:
        """Try what is due, and wait for more only while over `limit` entries are queued."""
        while self.unsent or self.refused:
            if self.available():
                if self.unsent:
                    self.attempt(self.unsent.popleft())
                    continue
                first = self.refused[0]
                if first.due <= self.now() or self.accepted > first.accepted or self.given_up:
                    self.attempt(self.refused.popleft())
                    continue
                until = first.due
            else:
                until = min(self.state[host].until for host in self.hosts)
            if self.queued <= limit:
                return
            self.wait(until)

    def attempt(self, batch: _Batch) -> None:
        """One try on a host that answers; a broken connection is a try, and another host follows at once."""
        reason = self.given_up
        while self.given_up is None and batch.tries < self.options.retries:
            if self.client is None:
                try:
                    self.connect()
                except ConnectionError as failure:
                    self.given_up = reason = str(failure)
                    break
            fresh = batch.tries == 0
            batch.tries += 1
            try:
                answer = self.client.send(batch.entries)
            except Exception as failure:
                reason = f"{self.host}: {failure!r}"
                self.drop(exclude=True)
                continue
            if answer is not False:
                self.accepted += 1
                self.hosts, self.state[self.host] = list(self.options.hosts), _Host()
                reason = None
                break
            reason = f"{self.host} asked to try later"
            self.note_refusal(fresh)
            if batch.tries < self.options.retries:
                batch.due, batch.accepted = self.now() + self.pause(batch.tries - 1), self.accepted
                self.refused.append(batch)
                return
        self.queued -= len(batch.entries)
        batch.settled(reason)

    def note_refusal(self, fresh: bool) -> None:
        """Leave a host alone that refuses whatever comes. A batch that is refused again says little about it."""
        state = self.state[self.host]
        if fresh or state.opened:
            state.refusals += 1
        if state.refusals >= self.options.breaker_refusals or state.opened:
            state.until = self.now() + self.pause(state.opened)
            state.opened += 1
            self.drop(exclude=False)

    def close(self) -> None:
        if self.client is not None:
            client, self.client = self.client, None
            try:
                client.close()
            except Exception:  # the connection is given up either way
                pass


def batches(rows: Iterable, size: int, max_interval_ms: int, clock=time.monotonic) -> Iterator:
    """Cut a partition into batches that are full, or old when the next row comes; then the rest."""
    batch, started = [], clock()
    for row in rows:
        batch.append(row)
        if len(batch) >= size or (clock() - started) * 1000 >= max_interval_ms:
            yield batch
            batch, started = [], clock()
    if batch:
        yield batch


def deliver_to_endpoint(entries: DataFrame, client_factory: Callable, options: EndpointOptions,
                        lanes: int | None = None) -> DataFrame:
    """Send all entries and return them with a column `error`, null for delivered ones.

    Entries without a message are passed through unsent. Sending happens when the result is
    evaluated, so write the result down once and read that. A task per input partition sends;
    `lanes` sets another number, at the price of a shuffle.
    """
    if lanes:
        entries = entries.repartition(lanes)
    schema = T.StructType([*entries.schema.fields, T.StructField("error", T.StringType())])

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(client_factory, options, TaskContext.get().partitionId())
        held = {}

        def rows():
            for number, frame in enumerate(frames):
                held[number] = [frame, [None] * len(frame), len(frame) - frame["message"].null_count]
                for at, entry in enumerate(zip(frame["category"].to_pylist(), frame["message"].to_pylist())):
                    if entry[1] is not None:
                        yield number, at, entry

        def settle(places):
            def settled(error):
                for number, at in places:
                    held[number][1][at] = error
                    held[number][2] -= 1
            return settled

        def finished():
            """Frames whose entries were all settled; a batch may span frames, and a refused one keeps its frame."""
            for number in [n for n, (_, _, waiting) in held.items() if not waiting]:
                frame, errors, _ = held.pop(number)
                yield pa.RecordBatch.from_arrays(
                    [*frame.columns, pa.array(errors, pa.string())], [*frame.schema.names, "error"])

        try:
            for batch in batches(rows(), options.batch_size, options.max_interval_ms):
                sender.offer([entry for _, _, entry in batch], settle([place[:2] for place in batch]))
                if len(held) > HELD_FRAMES:
                    sender.flush()
                yield from finished()
            sender.flush()
            yield from finished()
        finally:
            sender.close()

    return entries.mapInArrow(run, schema)


def endpoint_data_source(client_factory: Callable, format_name: str = "endpoint") -> type:
    """A data source class for `spark.dataSource.register`, for `write` and `writeStream`.

    Options: hosts (comma separated) and the other fields of `EndpointOptions`.
    A batch that cannot be sent fails its task. Use `deliver_to_endpoint` to keep such rows.
    """
    class Endpoint(DataSource):
        @classmethod
        def name(cls):
            return format_name

        def schema(self):
            return "category string, message string"

        def writer(self, schema, overwrite):
            return _Writer(client_factory, _options(self.options), schema.names)

        def streamWriter(self, schema, overwrite):
            return _StreamWriter(client_factory, _options(self.options), schema.names)

    return Endpoint


def write_endpoint(entries: DataFrame, client_factory: Callable, options: EndpointOptions) -> None:
    """Send all entries (category, message) of a batch, or fail."""
    entries.sparkSession.dataSource.register(endpoint_data_source(client_factory))
    given = asdict(options) | {"hosts": ",".join(options.hosts)}
    entries.write.format("endpoint").mode("append").options(**given).save()


def _options(given):
    numbers = {name: int(given[name]) for name in (
        "batch_size", "max_interval_ms", "retries", "all_down_wait_ms", "try_later_wait_ms", "wait_budget_ms",
        "queue_entries", "breaker_refusals") if given.get(name)}
    return replace(EndpointOptions(tuple(given["hosts"].split(","))), **numbers)


@dataclass
class Sent(WriterCommitMessage):
    entries: int


class _Write:
    def __init__(self, client_factory, options, names):
        self.factory, self.options = client_factory, options
        self.at = [names.index("category"), names.index("message")]

    def write(self, iterator) -> Sent:
        sender = Sender(self.factory, self.options, TaskContext.get().partitionId())
        sent = 0

        def settled(error):
            if error is not None:
                raise ConnectionError(error)

        rows = ((row[self.at[0]], row[self.at[1]]) for row in iterator)
        try:
            for batch in batches(rows, self.options.batch_size, self.options.max_interval_ms):
                sender.offer(batch, settled)
                sent += len(batch)
            sender.flush()
        finally:
            sender.close()
        return Sent(sent)


class _Writer(_Write, DataSourceWriter):
    def commit(self, messages):
        pass

    def abort(self, messages):
        pass


class _StreamWriter(_Write, DataSourceStreamWriter):
    def commit(self, messages, batchId):
        pass

    def abort(self, messages, batchId):
        pass
