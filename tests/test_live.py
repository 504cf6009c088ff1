"""Streams over several batches: pairing, throttles, timers that fire as the clock moves, and upserts into a stored table."""

import random

import pandas as pd
import pytest
from ledgerloom.streaming import live, store
from pyspark.sql import functions as F


def batches(spark, folder, rows, kind):
    """A stream that gives each list of rows as a batch of its own."""
    folder = str(folder)
    import os
    import pathlib

    for i, some in enumerate(rows):
        part = f"{folder}-part{i}"
        spark.createDataFrame(some, kind).coalesce(1).write.parquet(part)
        (name,) = pathlib.Path(part).glob("part-*.parquet")
        pathlib.Path(folder).mkdir(exist_ok=True)
        to = pathlib.Path(folder) / f"{i:03d}.parquet"
        os.rename(name, to)
        os.utime(to, (1_000_000 + i, 1_000_000 + i))
    return live.table_stream(spark, folder, files=1)


def test_pairs_wait_over_batches(spark, tmp_path):
    kind = "key long, place long, is_right boolean, value string"
    r = random.Random(4)
    lefts = {k: [(k, i, False, f"L{k}.{i}") for i in range(7)] for k in (1, 2)}
    rights = {k: [(k, i, True, f"R{k}.{i}") for i in range(5 + 4 * (k == 2))] for k in (1, 2)}
    parts = [[] for _ in range(4)]
    for side in (*lefts.values(), *rights.values()):
        cuts = sorted(r.randrange(len(side) + 1) for _ in range(3))
        for part, a, b in zip(parts, [0, *cuts], [*cuts, len(side)]):
            part += side[a:b]
    for p in parts:
        r.shuffle(p)
    # The rights of key 3 all come before its lefts.
    parts[0] += [(3, i, True, f"R3.{i}") for i in (1, 0)]
    parts[3] += [(3, 0, False, "L3.0"), (3, 1, False, None), (3, 2, False, "L3.2")]
    got = live.run_available(live.paired(batches(spark, tmp_path / "s", parts, kind))).collect()
    want = {(k, i + 1, f"L{k}.{i}", f"R{k}.{i}") for k, n in ((1, 5), (2, 7)) for i in range(n)} | {(3, 1, "L3.0", "R3.0"), (3, 2, None, "R3.1")}
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_throttle_remembers_over_batches(spark, tmp_path):
    kind = "key long, at long, row long, text string, forced boolean"
    parts = [[(1, 1000, 1, "long enough", False), (1, 1500, 2, "long enough", False), (1, 2199, 3, "long enough", False)], [(1, 2200, 4, "  short ", False), (1, 2300, 5, "long enough", False), (1, 2400, 6, "x", True), (2, 0, 7, None, False)], [(1, 3599, 8, "long enough", False), (1, 3600, 9, "long enough", False)]]
    got = live.run_available(live.throttled(batches(spark, tmp_path / "s", parts, kind), live.PREVIEW, live.PREVIEW_CHARS)).collect()
    assert sorted(x.row for x in got) == [1, 5, 6, 9]


def test_items_expire_as_the_clock_moves(spark, tmp_path):
    kind = "key long, at long, row long, kind string"
    hour = live.PENDING
    parts = [
        [(1, 0, 1, "ask"), (2, 0, 2, "ask"), (3, 0, 3, "ask"), (4, 10, 4, "answer")],
        [(1, hour - 1, 5, "ask"), (2, hour, 6, "answer")],  # asking again gives no more time; an answer just in time
        [(9, hour + 2, 7, "tick")],  # the clock moves by another key: 1 and 3 expire by their timers
        [(1, hour + 50, 8, "ask"), (1, hour + 60, 9, "answer"), (1, hour + 70, 10, "ask"), (1, hour + 80, 11, "answer")],
        [(9, 9 * hour, 12, "tick")],
    ]
    parts = [[(k, at + 5, *rest) for k, at, *rest in p] for p in parts]  # the clock starts above 0
    got = live.run_available(live.expiring(batches(spark, tmp_path / "s", parts, kind), lateness="0 seconds")).collect()
    want = [(1, 0, hour, "expired"), (1, 0, hour + 60, "late"), (1, hour + 70, hour + 80, "accepted"), (2, 0, hour, "accepted"), (3, 0, hour, "expired")]
    assert sorted((k, asked - 5, at - 5, v) for k, asked, at, v in got) == want


def test_silence_flushes_unless_a_tail_is_forming(spark, tmp_path):
    kind = "key long, at long, row long, final boolean, token string"
    parts = [
        [(1, 0, 1, True, "one"), (1, 100, 2, True, " two"), (2, 0, 3, True, "open"), (2, 50, 4, False, " wor"), (3, 0, 5, True, "  ")],
        [(9, 2600, 6, False, "tick")],  # 100 + 2500 is not yet past
        [(9, 2700, 7, False, "tick")],  # 1 is flushed by its timer, 2 has a tail
        [(1, 2800, 8, True, "three"), (2, 9000, 9, False, ""), (1, 5400, 10, True, "four")],  # the tail goes: 2 is flushed when the clock moves on
        [(9, 20000, 11, False, "tick")],
    ]
    parts = [[(k, at + 5, *rest) for k, at, *rest in p] for p in parts]
    got = live.run_available(live.idle_flushed(batches(spark, tmp_path / "s", parts, kind), lateness="0 seconds")).collect()
    assert sorted((k, n, last - 5, text) for k, n, last, text in got) == [(1, 0, 100, "one two"), (1, 1, 2800, "three"), (1, 2, 5400, "four"), (2, 0, 0, "open")]


def test_the_direct_source_ends_the_polling_of_its_room(spark, tmp_path):
    kind = "key long, at long, row long, direct boolean, idx long, text string"
    parts = [
        [(1, 10, 1, False, 0, "a"), (1, 20, 2, False, 0, "a"), (1, 30, 3, False, 1, None), (2, 10, 4, False, 0, "p")],
        [(1, 40, 5, False, 0, "ab"), (1, 45, 6, True, 7, "x"), (1, 45, 7, False, 0, "abc"), (2, 20, 8, False, 0, "p"), (2, 30, 9, False, 1, "")],
        [(1, 50, 10, False, 5, "late poll"), (1, 60, 11, True, 7, "x"), (2, 40, 12, False, 0, "q")],
    ]
    got = live.run_available(live.preferred(batches(spark, tmp_path / "s", parts, kind))).collect()
    assert sorted((x.row, x.key, x.idx, x.text) for x in got) == [(1, 1, 0, "a"), (3, 1, 1, ""), (4, 2, 0, "p"), (5, 1, 0, "ab"), (6, 1, 7, "x"), (9, 2, 1, ""), (11, 1, 7, "x"), (12, 2, 0, "q")]


class Counted(dict):
    """A map state or a value state that counts what it is asked and told."""

    def __init__(self):
        self.calls = 0

    def __getattribute__(self, name):
        if name in ("exists", "clear", "containsKey", "getValue", "updateValue", "update"):
            self.calls += 1
        return super().__getattribute__(name)

    def exists(self):
        return len(self) > 0

    def containsKey(self, k):
        return k in self

    def getValue(self, k):
        return self[k]

    def updateValue(self, k, v):
        self[k] = v

    def update(self, v):
        self["on"] = v


def test_a_batch_asks_the_state_once_a_segment(spark):
    held = Counted(), Counted()
    p = live.Precedence()
    p.init(type("Handle", (), {"getValueState": lambda *a: held[0], "getMapState": lambda *a: held[1]})())
    batch = lambda rows: [tuple(r)[1:] for f in p.handleInputRows((1,), iter([pd.DataFrame(rows, columns=["at", "row", "direct", "idx", "text"])]), None) for r in f.itertuples(index=False)]
    assert len(batch([(i, i, False, i % 2, f"{i // 4}") for i in range(100)])) == 50 and held[1] == {(0,): ("24",), (1,): ("24",)}
    assert batch([(100, 100, False, 1, "24"), (101, 101, False, 2, None)]) == [(101, 101, 2, "")]
    assert held[0].calls + held[1].calls <= 12
    assert batch([(102, 102, True, 9, "x"), (103, 103, False, 0, "y")]) == [(102, 102, 9, "x")] and not held[1]
    assert batch([(104, 104, False, 0, "y")]) == []


def test_results_for_a_text_that_has_gone_are_stale(spark, tmp_path):
    kind = "key long, at long, row long, result boolean, text string, made_for string"
    parts = [
        [(1, 10, 1, False, "good mor", None), (2, 10, 2, True, "early", "good")],
        [(1, 20, 3, False, "good morning", None), (1, 30, 4, True, "still it", "good mor"), (1, 40, 5, True, "another", "good night")],
        [(1, 50, 6, False, None, None), (1, 60, 7, True, "finished", "good morning"), (1, 70, 8, False, "next", None), (1, 80, 9, True, "next one", "next"), (1, 90, 10, True, "for nothing", None)],
    ]
    got = live.run_available(live.fresh_results(batches(spark, tmp_path / "s", parts, kind))).collect()
    assert sorted((x.row, x.version, x.fresh) for x in got) == [(2, 0, False), (4, 0, True), (5, 0, False), (7, 1, False), (9, 1, True), (10, 1, True)]


def test_who_joins_late_gets_the_backlog_and_then_all_changes(spark, tmp_path):
    import random

    table = store.Store(spark, f"{tmp_path}/t", "k", "seq", 4)
    assert table.changes() == (None, None)
    r, held, seen = random.Random(3), {}, None
    for batch in range(9):
        rows = [(r.randrange(40), r.randrange(1000) * 10 + batch, f"b{batch}") for _ in range(r.choice([0, 3, 30]))]
        table.merge(spark.createDataFrame(rows, "k long, seq long, v string"), batch)
        if batch == 5:
            table.vacuum()
        if batch in (2, 3, 6, 8):
            seen, new = table.changes(seen)
            held.update({x.k: tuple(x) for x in new.collect()})
            assert seen == batch and held == {x.k: tuple(x) for x in table.read().collect()}
    assert table.changes(8)[0] == 8 and not table.changes(8)[1].collect()


EVENTS = "channel string, ts string, thread_ts string, text string, bot boolean, subtype string, edited boolean, seq long"


def test_messages_are_merged_and_replays_change_nothing(spark, tmp_path, monkeypatch):
    parts = [
        [("C", "10", None, "root", False, None, None, 1), ("C", "11", "10", "a token=abc", True, None, False, 2), ("C", "12", "99", "elsewhere", False, None, False, 3), ("C", "", "10", "no ts", False, None, False, 4)],
        [("C", "11", "10", "b", True, None, True, 6), ("C", "13", " 10 ", "c", False, None, False, 5), ("C", "14", None, "another root", False, None, False, 7)],
        [("C", "13", "10", "", False, "message_deleted", False, 8), ("C", "11", "10", "late and older", True, None, False, 2)],
    ]
    table = store.Store(spark, f"{tmp_path}/t", "message_key", "seq", 4)
    stream = lambda: store.messages(live.table_stream(spark, f"{tmp_path}/s", files=1), F.lit("10"))
    batches(spark, tmp_path / "s", parts, EVENTS)
    # The second batch's manifest fails once: nothing of it shows, and it is run again.
    real, calls = table._commit, []

    def failing(manifest):
        calls.append(manifest["batch"])
        if calls == [0, 1]:
            raise OSError("lost")
        real(manifest)

    monkeypatch.setattr(table, "_commit", failing)
    with pytest.raises(Exception, match="lost"):
        table.follow(stream(), f"{tmp_path}/state")
    assert sorted((r.message_key, r.text) for r in table.read().collect()) == [("C:10", "root"), ("C:11", "a token=[REDACTED]")]
    table.follow(stream(), f"{tmp_path}/state")
    want = [("C:10", "user", "root", False, False, 1, 1), ("C:11", "assistant", "b", True, False, 6, 2), ("C:13", "user", "", False, True, 8, 5)]
    now = lambda: sorted((r.message_key, r.role, r.text, r.edited, r.deleted, r.seq, r.created) for r in table.read().collect())
    assert now() == want and calls == [0, 1, 1, 2]
    # A batch that is merged already, other columns, and files that no version names.
    again = store.messages(spark.createDataFrame([("C", "10", None, "changed", False, None, None, 100)], EVENTS), F.lit("10"))
    assert table.merge(again, 2) is False and now() == want
    with pytest.raises(ValueError, match="other columns"):
        table.merge(again.drop("role"), 3)
    assert table.vacuum() >= 1 and now() == want
    assert table.merge(again, 3) and [r[2] for r in now()][0] == "changed"
    assert table.merge(again.limit(0), 4) and len(now()) == 3


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    table = store.Store(spark, f"{tmp_path}/t", "k", "seq", 8)
    with pytest.raises(ValueError, match="nothing"):
        table.read()
    rows = lambda keys, seq: spark.createDataFrame([(k, seq, f"v{seq}") for k in keys], "k long, seq long, v string")
    table.merge(rows(range(100), 1), 0)
    before = table.manifest()["folders"]
    table.merge(rows([5], 2), 1)
    after = table.manifest()["folders"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert {(r.k, r.v, r.created) for r in table.read().where("k in (5, 6)").collect()} == {(5, "v2", 1), (6, "v1", 1)} and table.read().count() == 100
