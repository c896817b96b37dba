"""Streams: a retried batch sees the same base and gives the same rows; several batches equal one."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from passlane import schema as S
from passlane.plans.inputs import Inputs
from passlane.plans.queries import counter_start
from passlane.streaming import jobs as ST
from tests.conftest import SF


def rows_of(spark, path):
    return sorted(map(repr, spark.read.parquet(path).collect()))


def outputs(spark, root, names):
    return {n: rows_of(spark, f"{root}/{n}") for n in names}


def halves(df, col):
    edge = df.approxQuantile(col, [1 / 2], 0.0)[0]
    return [df.where(F.col(col) <= edge), df.where(F.col(col) > edge)]


def retried(spark, batch, parts, root, names):
    """Run all parts, each batch twice; every retry leaves all outputs as they were."""
    for n, part in enumerate(parts):
        batch(part, n)
        first = outputs(spark, root, names)
        batch(part, n)
        assert outputs(spark, root, names) == first
    assert all(first[n] for n in names)


def test_payment_batches_are_idempotent(spark):
    i, root = Inputs(spark, SF), ST.stream_root(spark, "t")
    clock = iter(dt.datetime(1998, 1, 1) + dt.timedelta(seconds=k) for k in range(100))
    batch = ST.payments_batch(spark, i.path("declarations"), i.locks, lambda: next(clock), root, buckets=4)
    retried(spark, batch, halves(i.raw_notifications, "event_id"), root, ["outcomes", "rejected"])
    table = ST.current_declarations(spark, i.path("declarations"), root)
    assert table.count() == i.declarations.count() and set(table.columns) == set(i.declarations.columns)
    changed = {r.ref_value: r.new_state for r in spark.read.parquet(f"{root}/outcomes").where("applied").collect()}
    before = {r.ref_value: (r.state, r.amend_state) for r in i.declarations.collect()}
    after = {r.ref_value: (r.state, r.amend_state) for r in table.collect()}
    assert changed and all(after[k] != before[k] for k in changed if changed[k] not in before[k])
    assert all(after[k] == before[k] for k in before if k not in changed)


def message(spark, event, ref, status="Successful"):
    body = json.dumps({"status": status, "reference": encode(ref)})
    return spark.createDataFrame([(event, dt.datetime(2020, 1, 1) + dt.timedelta(seconds=event), body)],
                                 "event_id long, ts timestamp_ntz, raw string")


def encode(ref):
    check = sum(w * x for w, x in zip(S.REFERENCE_WEIGHTS, [*S.REFERENCE_FIXED_VALUES, *map(int, f"{ref:010d}")]))
    return f"X{S.CHECK_ALPHABET[check % 23]}PR{ref:010d}"


def test_payment_batches_read_only_touched_buckets_and_are_folded(spark):
    i, root = Inputs(spark, SF), ST.stream_root(spark, "t")
    unpaid = [r.ref_value for r in i.declarations.where(F.col("state") == S.PENDING_PAYMENT).orderBy("ref_value").limit(9).collect()]
    batch = ST.payments_batch(spark, i.path("declarations"), i.locks.limit(0), i.as_of, root, buckets=4, compact_after=2)
    state = ST.payment_state(spark, root)
    read, real = [], ST.KeyedTable._files

    def spied(self, held, buckets):
        found = real(self, held, buckets)
        read.append(len(found.inputFiles()))
        return found

    most = []
    for n in range(8):
        read.clear()
        ST.KeyedTable._files = spied
        try:
            batch(message(spark, n, unpaid[n]), n)
        finally:
            ST.KeyedTable._files = real
        most.append(max(read))
        held = state.held(2 * n + 2)
        assert max(map(len, held.values())) <= 2 + 1  # a bucket is folded before it holds more
        assert len(state.touched(message(spark, n, unpaid[n]).select(F.lit(unpaid[n]).alias("ref_value")))) == 1
    assert max(most[4:]) <= max(most[:4]) <= 8  # the eighth batch reads no more than an early one
    now = {r.ref_value: r.state for r in ST.current_declarations(spark, i.path("declarations"), root).collect()}
    assert all(now[k] == S.PAID for k in unpaid[:8]) and now[unpaid[8]] == S.PENDING_PAYMENT


def test_a_later_batch_sees_what_earlier_ones_changed(spark):
    i, root = Inputs(spark, SF), ST.stream_root(spark, "t")
    key = i.declarations.where((F.col("state") == S.PENDING_PAYMENT) & F.col("amend_state").isNull()).first().ref_value
    batch = ST.payments_batch(spark, i.path("declarations"), i.locks.limit(0), i.as_of, root, buckets=4)
    for n, status in enumerate(["Failed", "Successful", "Cancelled"]):
        batch(message(spark, n, key, status), n)
    got = {r.event_id: (r.applied, r.new_state) for r in spark.read.parquet(f"{root}/outcomes").collect()}
    assert got == {0: (True, S.PAYMENT_FAILED), 1: (True, S.PAID), 2: (False, None)}


def test_unusable_messages_go_beside_the_outcomes(spark):
    i, root = Inputs(spark, SF), ST.stream_root(spark, "t")
    batch = ST.payments_batch(spark, i.path("declarations"), i.locks, i.as_of, root)
    odd = spark.createDataFrame([(1, dt.datetime(2020, 1, 1), "no json"), (2, dt.datetime(2020, 1, 1), '{"status": "Failed", "reference": "X"}'),
                                 (3, dt.datetime(2020, 1, 1), None)], "event_id long, ts timestamp_ntz, raw string")
    batch(odd, 0)
    assert {r.event_id: r.reject_reason for r in spark.read.parquet(f"{root}/rejected").collect()} == {
        1: "bad_shape", 2: "bad_reference", 3: "bad_shape"}
    assert spark.read.parquet(f"{root}/outcomes").count() == 0


def test_intake_batches_are_idempotent(spark):
    i, root = Inputs(spark, SF), ST.stream_root(spark, "t")
    start = counter_start(i)
    some = i.raw_submissions.where("seq % 10 = 0")
    batch = ST.intake_batch(spark, start, i.as_of, root)
    retried(spark, batch, halves(some, "seq"), root, ["accepted", "rejected"])
    numbers = [r.ref_value for n in ("accepted", "rejected") for r in spark.read.parquet(f"{root}/{n}").collect()
               if r.ref_value is not None]
    assert sorted(numbers) == list(range(start + 1, start + 1 + len(numbers)))
    assert ST.last_reference(spark, root) == start + len(numbers)


def test_a_body_sent_again_takes_one_number(spark):
    i, root = Inputs(spark, SF), ST.stream_root(spark, "t")
    some = i.raw_submissions.where("seq <= 40").withColumn("at", F.lit(dt.datetime(2020, 1, 1)))
    some = some.unionByName(some.where("seq = 1").withColumn("correlation_id", F.lit(None).cast("string")))
    for _ in range(2):
        some.write.mode("append").parquet(f"{root}/in")
        ST.stream_intake(spark, f"{root}/in", 100, i.as_of, root, event_time="at", once_within="1 hour")
    numbers = [r.ref_value for n in ("accepted", "rejected") for r in spark.read.parquet(f"{root}/{n}").collect()
               if r.ref_value is not None]
    from passlane.operators.intake import eligible_submissions
    assert sorted(numbers) == list(range(101, 101 + eligible_submissions(some).count()))
    assert ST.last_reference(spark, root) == 100 + len(numbers)


def test_timeout_batches_are_idempotent_and_follow_the_clock(spark):
    i, root = Inputs(spark, SF), ST.stream_root(spark, "t")
    times = iter([dt.datetime(1996, 1, 1), dt.datetime(1998, 1, 1), dt.datetime(2000, 1, 1)])
    batch = ST.timeout_batch(spark, i.path("declarations"), i.locks, lambda: next(times), root, buckets=4)
    names, sizes = ["removed", "tap"], []
    for n in range(3):
        batch(n)
        first = outputs(spark, root, names)
        locked = sorted(r.lock_id for r in ST.lock_table(spark, root).read().collect())
        batch(n)
        assert outputs(spark, root, names) == first and first["removed"] == first["tap"]
        assert sorted(r.lock_id for r in ST.lock_table(spark, root).read().collect()) == locked
        sizes.append(len(first["removed"]))
    assert 0 < sizes[0] < sizes[1] < sizes[2]  # later ticks find what has become stale since
    removed = spark.read.parquet(f"{root}/removed")
    assert removed.count() == removed.select("ref_value").distinct().count()
    left = ST.KeyedTable(spark, f"{root}/declarations").read()
    assert left.count() == i.declarations.count() - removed.count()


def test_locks_of_one_tick_hold_in_the_next_and_expire(spark):
    i, root = Inputs(spark, SF), ST.stream_root(spark, "t")
    start = dt.datetime(1998, 1, 1)
    table = ST.lock_table(spark, root, i.locks.limit(0))
    rows = i.declarations.orderBy("ref_value").limit(6).select("ref_value").persist()
    keys = [r.ref_value for r in rows.collect()]
    won = ST.acquire_in(table, rows.unionByName(rows).where(F.col("ref_value").isin(keys[:3])), start)
    assert sorted(r.lock_id for r in won.collect()) == keys[:3]  # one winner a key
    later = start + dt.timedelta(seconds=299)
    ST.expire_in(table, later)
    assert sorted(r.lock_id for r in ST.acquire_in(table, rows, later).collect()) == keys[3:]
    end = start + dt.timedelta(seconds=300)
    assert sorted(r.lock_id for r in ST.expire_in(table, end).collect()) == keys[:3]
    assert sorted(r.lock_id for r in ST.acquire_in(table, rows, end).collect()) == keys[:3]
    assert ST.release_in(table, rows).count() == 6 and ST.release_in(table, rows).count() == 0
    legacy = spark.createDataFrame([(1, start, None), (2, end, None)], "lock_id int, last_updated timestamp_ntz, last_updated_date timestamp_ntz")
    table.append(legacy)
    ST.expire_in(table, end + dt.timedelta(days=1))
    assert table.read().count() == 2  # a lock without a date never expires by TTL
    assert [r.lock_id for r in ST.sweep_in(table, start + dt.timedelta(seconds=301)).collect()] == [1]


def status_parts():
    t = [dt.datetime(2020, 1, k) for k in (1, 2, 3)]
    return [[(1, S.PENDING_PAYMENT, t[0]), (2, S.PAID, t[0]), (-70, S.PAID, t[0]), (None, S.PAID, t[0])],
            [(1, S.PAID, t[1]), (2, S.PENDING_PAYMENT, t[0]), (3, None, t[0]), (-70, "unknown", t[1])],
            [(2, S.PAYMENT_FAILED, t[2]), (2, S.PAID, t[1]), (1, S.PENDING_PAYMENT, t[0]), (3, S.PAID, None)]]


STATUS = "ref_value int, state string, last_updated timestamp_ntz"


def test_a_key_with_three_versions_counts_once(spark):
    root = ST.stream_root(spark, "t")
    for part in status_parts():
        spark.createDataFrame(part, STATUS).coalesce(1).write.mode("append").parquet(f"{root}/in")
        ST.stream_status(spark, f"{root}/in", root)
    got = {r.metric: r.value for r in ST.last_gauges(spark, root).collect()}
    assert got == {S.GAUGE_NAMES[S.PAID]: 1, S.GAUGE_NAMES[S.PAYMENT_FAILED]: 1, S.GAUGE_NAMES[S.PENDING_PAYMENT]: 0,
                   S.GAUGE_NAMES[S.PAYMENT_CANCELLED]: 0, S.GAUGE_NAMES[S.SUBMISSION_FAILED]: 0}


def test_a_counter_batch_that_runs_again_counts_once(spark):
    root = ST.stream_root(spark, "t")
    for n, part in enumerate(status_parts()):
        spark.createDataFrame(part, STATUS).coalesce(1).write.mode("append").parquet(f"{root}/in")
        ST.stream_status(spark, f"{root}/in", root)
        first = sorted(map(tuple, ST.last_gauges(spark, root).collect()))
        fs, commit = ST.file_system(spark, f"{root}/_checkpoint/commits/{n}")
        assert fs.delete(commit, False)  # as after a crash between the batch and its commit
        ST.stream_status(spark, f"{root}/in", root)
        assert sorted(map(tuple, ST.last_gauges(spark, root).collect())) == first


def test_counters_over_twenty_batches_read_only_what_is_new(spark):
    root, rows = ST.stream_root(spark, "t"), []
    schema, real = STATUS, ST.status_batch
    for n in range(20):
        part = [(k, S.STATES[(k + n) % 5], dt.datetime(2020, 1, 1 + n)) for k in range(300) if k % 3 == n % 3]
        rows += part
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    seen = []

    def spied(*a):
        run = real(*a)

        def batch(df, n):
            seen.append(df.count())
            run(df, n)
        return batch

    ST.status_batch = spied
    try:
        ST.stream_status(spark, f"{root}/in", root, max_files_per_trigger=1)
    finally:
        ST.status_batch = real
    assert len(seen) == 20 and max(seen[10:]) <= max(seen[:10])
    last = {}
    for k, s, t in rows:
        last[k] = max(last.get(k, (t, s)), (t, s))
    want = {S.GAUGE_NAMES[s]: sum(v[1] == s for v in last.values()) for s in S.STATES}
    assert {r.metric: r.value for r in ST.last_gauges(spark, root).collect()} == want


def test_dispatch_is_throttled_and_unused_slots_are_lost(spark):
    i, root = Inputs(spark, SF), ST.stream_root(spark, "t")
    rows = i.declarations.where("state = 'paid' and not sent_to_hod").orderBy("ref_value").limit(12).persist()
    keys = [r.ref_value for r in rows.collect()]
    held = i.locks.limit(0).unionByName(spark.createDataFrame(
        [(keys[2], dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 1))], "lock_id int, last_updated timestamp_ntz, last_updated_date timestamp_ntz"))
    start, ticks = dt.datetime(2020, 1, 1), [0, 1, 3, 3.5, 20, 21, 60, 61]
    times = iter(start + dt.timedelta(seconds=t) for t in ticks)
    batch = ST.dispatch_batch(spark, lambda: rows, held, lambda: next(times), root, elements=2, interval_seconds=60)
    for n in range(len(ticks)):
        batch(n)
        if n in (1, 6):
            first = outputs(spark, root, ["dispatched"])
            batch(n)
            assert outputs(spark, root, ["dispatched"]) == first
    sent = sorted((r.batch, (r.send_at - start).total_seconds(), r.ref_value) for r in spark.read.parquet(f"{root}/dispatched").collect())
    # two a second; the locked third row has used its slot up
    assert sent[:7] == [(0, 0, keys[0]), (0, 0, keys[1]), (1, 1, keys[3]), (2, 2, keys[4]), (2, 2, keys[5]), (2, 3, keys[6]), (2, 3, keys[7])]
    assert [s[2] for s in sent if s[0] == 4] == keys[8:]  # half a second later no slot is free; then the rest
    assert not [s for s in sent if s[0] in (3, 5)]
    # the next listing opens a minute after the first, with the slots of that moment and no more
    assert [s[1:] for s in sent if s[0] == 6] == [(60, keys[0]), (60, keys[1])]
    assert [s[1:] for s in sent if s[0] == 7] == [(61, keys[3])]


def test_a_clock_ticks_without_new_files(spark):
    i, root = Inputs(spark, SF), ST.stream_root(spark, "t")
    out = ST.periodic_source(spark, i.path("locks"), lambda t: t, root, every="1 second", runs=3)
    assert spark.read.parquet(out).select("batch").distinct().count() == 3


# -- stored tables

def test_partial_and_stale_tables_are_not_served(spark, tmp_path):
    import os
    import shutil

    from passlane.plans import inputs as P

    folder = tmp_path / "sf"
    shutil.copytree(SF, folder)
    os.chmod(folder, 0o755)
    i = Inputs(spark, str(folder))
    want = i.locks.count()
    path = P._fs(spark, i.path("locks"))[1].toUri().getPath()
    os.remove(f"{path}/_SUCCESS")  # as after a crash between the files and the marker
    for f in sorted(os.listdir(path))[:1]:
        os.remove(f"{path}/{f}")
    again = Inputs(spark, str(folder))
    assert again.locks.count() == want and not again.path("locks").endswith(path.rsplit("/", 1)[1])
    os.chmod(folder / "orders.parquet", 0o644)
    spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey < 100").coalesce(1).write.parquet(str(tmp_path / "less"))
    part = next(f for f in os.listdir(tmp_path / "less") if f.endswith(".parquet"))
    shutil.copyfile(tmp_path / "less" / part, folder / "orders.parquet")
    assert Inputs(spark, str(folder)).declarations.count() < i.declarations.count()


def test_a_cluster_needs_a_shared_folder():
    from passlane.session import ensure_checkpoint_dir

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_submissions_come_as_text(spark, tmp_path):
    from passlane.operators.intake import is_json_object
    from passlane.sources.tables import read_submissions_text

    (tmp_path / "in.jsonl").write_text('{"a": 1}\n[1]\n')
    got = read_submissions_text(spark, str(tmp_path / "in.jsonl")).select("raw", is_json_object()).collect()
    assert [(r.raw, r[1]) for r in got] == [('{"a": 1}', True), ("[1]", False)]
