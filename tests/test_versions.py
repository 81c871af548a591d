"""The store: commits that overlap, logs of versions, their compaction, zones, and what is read and written."""

import glob

import pytest
from pyspark.sql import functions as F

from millrace.operators.tables import incremental_slice, upsert_current
from millrace.operators.validation import ROW, validate
from millrace.operators.versions import Conflict, Store, day

RAW = "k long, v string, _record_checksum string, updated_at timestamp_ntz"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def versions(spark, *given):
    return spark.createDataFrame([(k, v, f"{v}{t}") for k, v, t in given], "k long, v string, _record_checksum string").withColumn("updated_at", F.timestamp_seconds(F.substring("_record_checksum", 2, 9).cast("long")).cast("timestamp_ntz"))


def test_two_writers_on_whole_tables(spark, store):
    store.commit({"a": spark.range(1)})
    one, two = store.stage({"b": spark.range(2)}), store.stage({"c": spark.range(3)})
    store.publish(two)
    store.publish(one)  # another table: nothing is lost
    assert {t: store.read(t).count() for t in "abc"} == {"a": 1, "b": 2, "c": 3}
    one, two = store.stage({"a": spark.range(5)}), store.stage({"a": spark.range(6)})
    store.publish(two)
    with pytest.raises(Conflict):
        store.publish(one)
    assert store.read("a").count() == 6 and store.read("a", 1).count() == 1
    assert store.retried(lambda: store.stage({"a": spark.range(7)})) == store.version() and store.read("a").count() == 7


def test_two_writers_on_parts(spark, store):
    days = lambda d, *ks: spark.createDataFrame([(k, f"2024-01-0{d} 00:00:00") for k in ks], "k long, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    put = lambda df: store.stage_merge("t", df, day("t"), lambda old, new: old.unionByName(new))
    store.publish(put(days(1, 1)))
    one, two = put(days(2, 2)), put(days(3, 3))
    store.publish(two)
    store.publish(one)
    assert {r[0] for r in store.read("t").collect()} == {1, 2, 3}
    one, two = put(days(1, 4)), put(days(1, 5))
    store.publish(two)
    with pytest.raises(Conflict):
        store.publish(one)
    assert {r[0] for r in store.read("t").collect()} == {1, 2, 3, 5}
    # zones: counts and bounds without a job, and only the days asked for are read
    entry = store.manifest()["t"]
    assert store.rows(entry) == 4 and store.bounds(entry, "t") == ("2024-01-01 00:00:00", "2024-01-03 00:00:00") and store.bounds(entry, "k") == (1, 5)
    files = store.read("t", where={"t": ("2024-01-02 12:00:00", None)}).inputFiles()
    assert files and all("2024-01-03" in f for f in files)
    source = spark.createDataFrame([("2024-01-01 01:00:00",), ("2024-01-01 00:00:00",), ("2023-12-31 23:59:59",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    assert incremental_slice(source, "t", latest=store.bounds(entry, "t")[1]).count() == 2


def test_rows_added_by_two_writers_are_all_kept(spark, store):
    add = lambda *given: store.stage_rows("raw", versions(spark, *given), ["k"], "current")
    one, two = add((1, "a", 1), (2, "a", 5)), add((1, "b", 2), (2, "b", 3), (3, "b", 1))
    store.publish(two)
    store.publish(one)
    assert [r[:2] for r in rows(store.read("raw"))] == [(1, "b"), (2, "a"), (3, "b")]  # by clock, not by who came last
    with pytest.raises(ValueError):
        store.stage_rows("raw", versions(spark), ["v"], "current")


def test_a_log_equals_a_full_upsert(spark, store, tmp_path):
    target = versions(spark, *((k, "a", 10) for k in range(2000)))
    store.publish(store.stage_rows("raw", target, ["k"], "current"))
    assert store.compact(force=True, most_rows=300) == ["raw"]
    parts = store.manifest()["raw"]["parts"]
    assert len(parts) == 8 and sum(p["rows"] for p in parts.values()) == 2000 and store.rows(store.manifest()["raw"]) == 2000
    for n in range(3):
        batch = versions(spark, *((k, "bcd"[n], 9 + (k + n) % 3) for k in range(n * 700, n * 700 + 1000, 5)))
        before = set(glob.glob(f"{tmp_path}/store/data/raw/**/*.parquet", recursive=True))
        store.publish(store.stage_rows("raw", batch, ["k"], "current"))
        new = set(glob.glob(f"{tmp_path}/store/data/raw/**/*.parquet", recursive=True)) - before
        assert sum(spark.read.parquet(f"file://{f}").count() for f in new) == 200  # the batch, and no stored row
        target = upsert_current(target, batch, "k")
        assert rows(store.read("raw")) == rows(target)
    expected = rows(target)
    # compaction: parts that no key fell in stay, large ones are split again; repeated, it does nothing
    store.publish(store.stage_rows("raw", versions(spark, *((k, "e", 99) for k in range(10_000, 13_000))), ["k"], "current"))
    expected += rows(versions(spark, *((k, "e", 99) for k in range(10_000, 13_000))))
    late = store.stage_rows("raw", versions(spark, (7, "z", 500)), ["k"], "current")
    assert store.compact(force=True, most_rows=300) == ["raw"] and store.compact(force=True, most_rows=300) == []
    assert rows(store.read("raw")) == sorted(expected, key=str)
    assert len(store.manifest()["raw"]["parts"]) > 8 and max(p["rows"] for p in store.manifest()["raw"]["parts"].values()) <= 600
    store.publish(late)  # staged before the compaction, put on top of it
    assert {r.k: r.v for r in store.read("raw").collect()}[7] == "z"
    # one key touches one part
    before = store.manifest()["raw"]["parts"]
    store.compact(force=True)
    after = store.manifest()["raw"]["parts"]
    assert sum(before[k] != after.get(k) for k in before) == 1


def test_two_compactions_and_a_tombstone(spark, store):
    put = lambda df, **more: store.publish(store.stage_rows("t", df, ["k"], **more))
    frame = lambda *given: spark.createDataFrame(list(given), "k long, v string, m map<string,string>")
    put(frame((1, "a", {"x": "y"}), (2, "a", None), (None, "n", None)))
    put(frame((2, "b", None)), gone=spark.createDataFrame([(1,), (9,)], "k long"))
    assert [(r.k, r.v) for r in store.read("t").orderBy("k").collect()] == [(None, "n"), (2, "b")]
    one, two = store.stage_compaction("t"), store.stage_compaction("t")
    put(frame((1, "c", None), (None, "m", None)))  # a key that was gone comes again
    store.publish(one)
    with pytest.raises(Conflict):
        store.publish(two)
    assert [(r.k, r.v) for r in store.read("t").orderBy("k").collect()] == [(None, "m"), (1, "c"), (2, "b")]
    assert store.compact(force=True) == ["t"] and store.read("t").count() == 3


def test_rules_of_logs(spark, store):
    put = lambda name, rule, *given: store.publish(store.stage_rows(name, spark.createDataFrame(list(given), "k long, check_name string, status string"), ["k"], rule))
    for name, rule in (("first", "first"), ("last", "last"), ("outcome", "outcome")):
        put(name, rule, (1, "n", "s"))
        put(name, rule, (1, "o", "t"), (2, "p", "u"))
    assert [rows(store.read(n))[0] for n in ("first", "last", "outcome")] == [(1, "n", "s"), (1, "o", "t"), (1, "n", "t")]
    for k in range(2):
        store.publish(store.stage_rows("all", spark.range(3), []))
    assert store.read("all").count() == 6 == store.rows(store.manifest()["all"])
    assert store.compact(["all"], force=True) == ["all"] and store.read("all").count() == 6
    store.publish(store.stage_rows("none", spark.range(0), ["id"]))
    assert store.read("none").count() == 0 and not store.due(store.manifest()["none"])


def test_logs_are_compacted_when_due(spark, store):
    for k in range(10):
        store.publish(store.stage_rows("t", spark.range(k, k + 2), ["id"]))
    assert store.due(store.manifest()["t"]) and store.compact() == ["t"] and store.manifest()["t"]["deltas"] == []
    assert rows(store.read("t")) == [(k,) for k in sorted(range(11), key=lambda k: str((k,)))]


def test_vacuum_keeps_what_is_named_or_young(spark, store):
    for n in range(4):
        store.commit({"t": spark.range(n)})
    store.publish(store.stage_rows("l", spark.range(3), ["id"]))
    store.compact(force=True)
    staged = store.stage({"t": spark.range(9)})
    assert store.vacuum(keep=2) == []  # nothing is a week old
    gone = store.vacuum(keep=2, age=0)
    assert len(gone) == 4 and staged["t"]["entry"]["whole"]["at"] in gone  # three versions of t, and what was staged: age 0 says it isn't needed
    assert store.read("t").count() == 3 and store.read("l").count() == 3 and store.read("t", store.version() - 1).count() == 3
    assert store.manifest(store.version() - 1) and not store._fs.exists(store._path("manifests/000000000001.json"))


def test_a_search_for_keys_leaves_files_alone(spark, store):
    clock = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("n") % 5 * 86_400).cast("timestamp_ntz").alias("t")
    df = spark.range(20_000).select(F.col("id").alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("k")).select("k", "n", clock)
    store.publish(store.stage_merge("t", df, day("t"), lambda old, new: new, keys=["k"]))
    entry = store.manifest()["t"]
    wanted = df.filter("n in (7, 12, 17)")  # all of one day
    found = store.find(entry, entry["parts"], "k", wanted.unionByName(spark.createDataFrame([("absent", -1, None)], wanted.schema)))
    assert sorted(r.n for r in found.collect()) == [7, 12, 17]
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert 0 < scan.metrics().apply("numOutputRows").value() <= 4_000  # of five files, one was read
    many = store.find(entry, entry["parts"], "k", df.filter("n < 10500"))
    assert many.count() == 10_500


def test_a_broken_commit_is_not_seen(spark, store, monkeypatch):
    store.commit({"t": spark.range(1)})
    staged = store.stage({"t": spark.range(2)}) | store.stage_rows("l", spark.range(3), ["id"])
    with monkeypatch.context() as m:
        m.setattr(Store, "_claim", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.publish(staged)
    assert store.read("t").count() == 1 and store.read("l") is None
    # a rename that another commit was quicker at is tried again on top of it
    real, calls = Store._claim, []

    def slow(self, draft, final):
        calls.append(final)
        if len(calls) == 1:
            real(self, self._copy_for_test(draft), final)
        return real(self, draft, final)

    monkeypatch.setattr(Store, "_copy_for_test", lambda self, draft: (self._write("manifests/.other", '{"o": {"whole": {"at": "x", "rows": 0, "zones": {}}}, "t": ' + __import__("json").dumps(self.manifest()["t"]) + "}"), "manifests/.other")[1], raising=False)
    monkeypatch.setattr(Store, "_claim", slow)
    assert store.publish(staged) == 3 and "o" in store.manifest() and store.read("t").count() == 2


def test_one_key_of_all_rows_is_no_window(spark):
    from millrace.operators.contracts import CONTRACTS

    contract = CONTRACTS["factories"]
    one = spark.range(50_000).select((F.col("id") + 2).alias(ROW), *(F.lit("FAC-001").alias(c) if c == contract.key else F.lit(None).cast("string").alias(c) for c in contract.columns))
    judged = validate(one.unionByName(one.limit(5).withColumn(contract.key, F.lit(None).cast("string"))), contract, "2024-01-31 00:00:00")
    assert "Window" not in judged._jdf.queryExecution().executedPlan().toString()
    repeated = judged.filter(F.exists("reasons", lambda r: r["code"] == "duplicate_identifier"))
    assert repeated.count() == 49_999 and repeated.agg(F.min(ROW)).first()[0] == 3
