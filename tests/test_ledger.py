"""Commits of several writers, and sinks whose batches die, repeat or meet."""

from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cashtide.operators.contracts import Rule
from cashtide.sources import ledger
from cashtide.sources.ledger import Conflict, Ledger, Part, parts_of
from cashtide.streaming import revenue

DDL = "event_id long, ts timestamp, event_type string, value double"
START = datetime(2024, 1, 1, 12)


def add_file(spark, path, rows):
    spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(path)


def events(ids, value=1.0, day=0):
    return [(i, START + timedelta(days=day), "click", value) for i in ids]


@pytest.fixture
def place(spark, tmp_path):
    return Ledger(spark, str(tmp_path / "ledger"))


def test_a_number_is_taken_once(place):
    assert place.commits() == []
    first = place.append([], "a", 0, [Part("t", "p0")])
    with pytest.raises(Conflict):
        place.append([], "b", 0, [Part("t", "p1")])
    second = place.append([first], "b", 0, [Part("t", "p1", "k"), Part("u", "p2")])
    assert place.commits() == [first, second] and (first.version, second.version) == (0, 1)
    assert not [p for p in Path(place.folder).iterdir() if "draft" in p.name and not p.name.endswith(".crc")]


def test_a_repeated_writer_finds_its_commit(place):
    calls = []
    store = lambda commits: calls.append(len(commits)) or [Part("t", f"p{len(calls)}")]
    assert place.once("a", 3, store) == place.once("a", 3, store)
    assert calls == [0] and place.once("a", 4, store).version == 1


def test_the_later_of_two_looks_again(place):
    seen = []

    def store(commits):
        seen.append([c.writer for c in commits])
        if len(seen) == 1:  # another writer is faster
            place.append(commits, "fast", 0, [Part("t", "theirs")])
        return [Part("t", f"mine-{len(seen)}")]

    assert place.once("slow", 0, store).version == 1
    assert seen == [[], ["fast"]] and [p.path for p in parts_of(place.commits(), "t")] == ["theirs", "mine-2"]


def test_keys_replace_only_their_own_writer(place):
    known = []
    for writer, path, key in (("a", "p0", "k"), ("b", "p1", "k"), ("a", "p2", "k"), ("a", "p3", None), ("a", "p4", None)):
        known.append(place.append(known, writer, len(known), [Part("t", path, key)]))
    assert [p.path for p in parts_of(place.commits(), "t")] == ["p1", "p2", "p3", "p4"]


def test_a_summary_stands_for_what_came_before(place, monkeypatch):
    monkeypatch.setattr(ledger, "SUMMARY_EVERY", 3)
    known = []
    for i in range(8):
        known.append(place.append(known, "w", i, [Part("t", f"p{i}")]))
    assert place.commits() == known
    for i in range(6):  # what a summary holds is not opened any more
        (Path(place.folder) / f"{i:020d}.json").write_text("not json")
    assert place.commits() == known


class Feed:
    """A folder of files and streams over it."""

    def __init__(self, spark, tmp_path, name="feed"):
        self.spark, self.path = spark, str(tmp_path / name)

    def add(self, rows):
        add_file(self.spark, self.path, rows)

    def stream(self):
        return revenue.file_stream(self.spark, self.path, DDL)


def kept_ids(spark, table, schema):
    return sorted(r.event_id for r in revenue.read_ingested(spark, table, schema).collect())


def test_another_checkpoint_overwrites_nothing(spark, tmp_path):
    feed, table = Feed(spark, tmp_path), str(tmp_path / "table")
    feed.add(events(range(10)))
    run = lambda name: revenue.ingest_to(feed.stream(), "event_id", "ts", table, str(tmp_path / name)).awaitTermination()
    run("first")
    feed.add(events([10]))
    run("second")  # begins anew at batch 0 and sees all files again
    run("first")
    assert kept_ids(spark, table, feed.stream().schema) == list(range(11))


def test_two_feeds_share_a_table(spark, tmp_path):
    table, feeds = str(tmp_path / "table"), [Feed(spark, tmp_path, n) for n in "ab"]
    for i, feed in enumerate(feeds):
        feed.add(events(range(5 * i, 5 * i + 8)))
        revenue.ingest_to(feed.stream(), "event_id", "ts", table, str(tmp_path / f"cp{i}")).awaitTermination()
    assert kept_ids(spark, table, feeds[0].stream().schema) == list(range(13))


@pytest.mark.parametrize("dies", ["before the commit", "after the commit"])
def test_a_killed_batch_is_repeated(spark, tmp_path, monkeypatch, dies):
    feed, table, checkpoint = Feed(spark, tmp_path), str(tmp_path / "table"), str(tmp_path / "cp")
    run = lambda: revenue.ingest_to(feed.stream(), "event_id", "ts", table, checkpoint).awaitTermination()
    feed.add(events(range(4)))
    run()
    feed.add(events(range(2, 9)))
    real = Ledger.append

    def dying(self, *args):
        if dies.startswith("after"):
            real(self, *args)
        raise RuntimeError("killed")

    with monkeypatch.context() as patch:
        patch.setattr(Ledger, "append", dying)
        with pytest.raises(Exception, match="killed"):
            run()
    run()
    run()
    assert kept_ids(spark, table, feed.stream().schema) == list(range(9))
    assert len(list(Path(table).glob("stream_id=*/batch_id=1/attempt=*"))) == (2 if dies.startswith("before") else 1)


def test_streams_at_the_same_time_do_not_write_a_key_twice(spark, tmp_path, monkeypatch):
    table, feeds = str(tmp_path / "table"), [Feed(spark, tmp_path, n) for n in "ab"]
    feeds[0].add(events(range(6)))
    feeds[1].add(events(range(3, 9)))
    run = lambda i: revenue.ingest_to(feeds[i].stream(), "event_id", "ts", table, str(tmp_path / f"cp{i}")).awaitTermination()
    real, state = Ledger.append, {"first": True}

    def slow(self, *args):
        if state.pop("first", False):
            run(1)  # the other stream begins and ends between this one's reading and its commit
        return real(self, *args)

    monkeypatch.setattr(Ledger, "append", slow)
    run(0)
    assert kept_ids(spark, table, feeds[0].stream().schema) == list(range(9))


def test_the_earliest_of_differing_rows_stays(spark):
    rows = [(1, START, "b", 1.0), (1, START - timedelta(days=1), "a", 2.0), (1, None, "c", 3.0), (2, None, "d", 4.0), (2, None, "d", 4.0)]
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, DDL).repartition(3)
        kept = revenue.first_deliveries(frame, "event_id", "ts").collect()
        assert sorted((r.event_id, r.event_type) for r in kept) == [(1, "a"), (2, "d")]


def windows_run(spark, feed, table, checkpoint):
    windows = revenue.windowed_revenue(feed.stream(), "event_type", "value", "ts")
    revenue.windows_to(windows, table, checkpoint).awaitTermination()
    found = revenue.newest_windows(spark, table, windows.schema).collect()
    return sorted((r.window_start.day, r.category, r.n, float(r.revenue)) for r in found)


def test_a_batch_rewrites_only_its_days(spark, tmp_path):
    feed, table = Feed(spark, tmp_path), str(tmp_path / "table")
    for day in range(6):
        feed.add(events(range(3), 1.25, day))
    feed.add([(9, START, "view", 2.0)])
    before = windows_run(spark, feed, table, str(tmp_path / "cp"))
    assert before == sorted([*((d + 1, "click", 3, 3.75) for d in range(6)), (1, "view", 1, 2.0)])
    files = lambda: {str(p) for p in Path(table).glob("stream_id=*/batch_id=*/attempt=*/day=*/*.parquet")}
    first = files()
    feed.add([*events([7], 1.0, 0), *events([8], 1.0, 6)])  # a late row and a new day
    after = windows_run(spark, feed, table, str(tmp_path / "cp"))
    assert after == sorted([(1, "click", 4, 4.75), (1, "view", 1, 2.0), *((d + 1, "click", 3, 3.75) for d in range(1, 6)), (7, "click", 1, 1.0)])
    assert first < files() and {p.split("day=")[1][:10] for p in files() - first} == {"2024-01-01", "2024-01-07"}
    assert len(files() - first) == 2
    commits = Ledger(spark, f"{table}/_ledger").commits()
    assert {p.key for p in commits[-1].parts} == {"2024-01-01", "2024-01-07"}


def test_windows_of_two_feeds_add_up_and_repeats_do_not(spark, tmp_path, monkeypatch):
    table, feeds = str(tmp_path / "table"), [Feed(spark, tmp_path, n) for n in "ab"]
    for feed in feeds:
        feed.add(events(range(3)))
    windows_run(spark, feeds[0], table, str(tmp_path / "cp0"))
    real = Ledger.append

    def dying(self, *args):
        real(self, *args)
        raise RuntimeError("killed")

    with monkeypatch.context() as patch:
        patch.setattr(Ledger, "append", dying)
        with pytest.raises(Exception, match="killed"):
            windows_run(spark, feeds[1], table, str(tmp_path / "cp1"))
    assert windows_run(spark, feeds[1], table, str(tmp_path / "cp1")) == [(1, "click", 6, 6.0)]


def test_both_sinks_of_a_batch_are_seen_together(spark, tmp_path, monkeypatch):
    feed, good, bad = Feed(spark, tmp_path), str(tmp_path / "good"), str(tmp_path / "bad")
    rules = [Rule("value_positive", "value", F.col("value") > 0)]
    run = lambda name: revenue.quarantine_to(feed.stream(), rules, good, bad, str(tmp_path / name)).awaitTermination()
    counts = lambda: tuple(x.count() for x in revenue.read_judged(spark, good, bad, DDL))
    assert counts() == (0, 0)
    feed.add([*events(range(3)), *events([8], -1.0)])
    with monkeypatch.context() as patch:
        patch.setattr(Ledger, "append", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(Exception, match="killed"):
            run("cp")
    assert counts() == (0, 0)  # written, but no commit names it
    run("cp")
    run("cp")
    assert counts() == (3, 1)
    other = Feed(spark, tmp_path, "other")
    other.add([*events([20]), *events([21], -2.0)])
    revenue.quarantine_to(other.stream(), rules, good, bad, str(tmp_path / "cp2")).awaitTermination()
    assert counts() == (4, 2)
    found = revenue.read_judged(spark, good, bad, f"{DDL}, reasons array<string>, batch_id long")[1].collect()
    assert {tuple(r.reasons) for r in found} == {("value_positive",)} and {r.batch_id for r in found} == {0}
