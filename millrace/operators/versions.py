"""Atomic publication of several tables at once, over plain parquet.

A commit writes what is new to new folders and then one manifest that names the folders of every table; readers go by the newest
manifest. A commit that fails before its manifest leaves nothing that a reader sees, and may be repeated. Files are reached by Hadoop's
file system, so that any store Spark can write to will do, if it renames a file only where none is yet.

Commits may overlap. What is staged knows what it was made from, and is put on top of whatever has been published since: rows that are
only added always fit, a part that is replaced must still be the one that was read, and so must a whole table. Otherwise the commit
fails with `Conflict`, and nothing of it is seen.

A table is kept in one of three ways:

- whole: one folder, replaced as such;
- parts: a folder for each value of a part column (a day, say); a merge reads and writes the parts that its rows fall in;
- log: rows in parts by the bits of a hash of the key, and deltas on top, one for each commit, tombstones included. A commit writes its
  own rows and reads nothing; reading folds each key's versions by the table's rule. Compaction folds deltas into the parts they fall
  in, and splits parts that have grown too large, so that neither their number nor their size is fixed.

The manifest has the number of rows of each folder and the bounds of its columns (its zones), observed while it was written. They prune
what is read, and answer for bounds and row counts without a job.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The column by which parts are written; readers don't see it.
PART = "_part"
GONE, SEQ = "_gone", "_seq"
#: Bits of a key's hash by which the parts of a log may be told apart.
BITS = 20
#: Rows of a part of a log before it is split, deltas of a log and their share of its rows before it is compacted.
MOST_ROWS, MOST_DELTAS, MOST_SHARE = 4_000_000, 8, 0.25
#: Keys that a search gives to the scan.
MOST_KEYS = 10_000
#: Types whose bounds are kept.
ZONED = (T.TimestampNTZType, T.DateType, T.LongType, T.IntegerType)
#: Seconds between signs of life of a run, and after which it counts as dead.
BEAT, DEAD = 30.0, 150.0
Piece = dict
Entry = dict
Staged = dict


class Conflict(RuntimeError):
    """What a commit was made from has been replaced by another commit."""


def day(clock: str) -> Column:
    """The day of a time as a part."""
    return F.coalesce(F.date_format(clock, "yyyy-MM-dd"), F.lit("none"))


def hash_bits(key: list[str]) -> Column:
    """The bits of a key's hash, as text."""
    return F.lpad(F.conv(F.pmod(F.xxhash64(*key), F.lit(1 << BITS)).cast("string"), 10, 2), BITS, "0")


#: How a key's next version goes with the one so far: (now, next, column) to the column's value.
def _last(now: Column, new: Column, column: str) -> Column:
    return new[column]


def _first(now: Column, new: Column, column: str) -> Column:
    return now[column]


def _current(now: Column, new: Column, column: str) -> Column:
    """The next version if its checksum differs and its clock isn't earlier."""
    changed = ~now["_record_checksum"].eqNullSafe(new["_record_checksum"]) & F.coalesce(new["updated_at"] >= now["updated_at"], F.lit(False))
    return F.when(changed, new[column]).otherwise(now[column])


def _outcome(now: Column, new: Column, column: str) -> Column:
    """Status, observed value, evidence and time of the next version, what the check is of the first one."""
    fixed = ("check_name", "check_type", "scope", "severity", "expected")
    return F.coalesce(now[column], new[column]) if column in fixed else new[column]


RULES: dict[str, Callable[[Column, Column, str], Column]] = {"last": _last, "first": _first, "current": _current, "outcome": _outcome}


def _text(value: object) -> object:
    return value.isoformat(" ") if isinstance(value, datetime) else value.isoformat() if isinstance(value, date) else value


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fold(base: DataFrame | None, deltas: list[DataFrame], key: list[str], rule: str, columns: list[str]) -> DataFrame:
    """The rows of base with the deltas' versions of their keys folded in, in order; a key whose last version is a tombstone is gone.

    A key has at most one row in base, and few in deltas. Base isn't shuffled where the deltas are small enough to be broadcast."""
    rows = [d.select(*columns, F.lit(i).alias(SEQ), *([GONE] if GONE in d.columns else [F.lit(False).alias(GONE)])) for i, d in enumerate(deltas)]
    listed = F.array_sort(F.collect_list(F.struct(SEQ, GONE, F.struct(*columns).alias("row"))), lambda a, b: a[SEQ] - b[SEQ])  # rows may hold maps
    versions = _union(rows).groupBy(*key).agg(listed.alias("_new"))
    versions = versions.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(key)})
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
    step = lambda now, new: F.when(
        new[GONE] | now.isNull(), F.when(~new[GONE], new["row"])
    ).otherwise(F.struct(*(RULES[rule](now, new["row"], c).alias(c) for c in columns)))
    nothing = F.element_at("_new", 1)["row"]
    fresh = versions.select(F.aggregate("_new", F.when(F.lit(False), nothing), step).alias("row"), *(f"_k{i}" for i in range(len(key))))
    if base is not None:
        kept = base.select(*columns)
        known = kept.join(versions, same, "left").select(F.when(F.col("_new").isNull(), F.struct(*columns)).otherwise(F.aggregate("_new", F.struct(*columns), step)).alias("row"))
        fresh = fresh.join(base.select(*key), same, "left_anti").select("row")
        fresh = known.unionByName(fresh)
    return fresh.filter("row is not null").select("row.*")


class Store:
    def __init__(self, spark: SparkSession, home: str) -> None:
        self.spark, self.home = spark, home.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}")

    # files

    def _write(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def _claim(self, draft: str, final: str) -> bool:
        """Renames a file where there is none of that name yet."""
        sc = self.spark.sparkContext
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration())
        how = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        try:
            files.rename(self._path(draft), self._path(final), sc._gateway.new_array(how, 0))
        except Exception as e:
            if "FileAlreadyExists" not in str(e) and not self._fs.exists(self._path(final)):
                raise
            self._fs.delete(self._path(draft), False)
            return False
        return True

    def version(self) -> int:
        folder = self._path("manifests")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict[str, Entry]:
        version = self.version() if version is None else version
        if not version:
            return {}
        rows = self.spark.read.text(f"{self.home}/manifests/{version:012d}.json", wholetext=True).collect()
        return json.loads(rows[0][0])

    @staticmethod
    def _filtered(df: DataFrame, keys: Iterable[str]):
        """A writer that puts a Bloom filter of each key column into the files, by which a search for keys leaves them alone."""
        writer = df.write
        for k in keys:
            if isinstance(df.schema[k].dataType, T.StringType | T.LongType | T.IntegerType):
                writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
        return writer

    def _put(self, name: str, df: DataFrame, keys: Iterable[str] = ()) -> Piece:
        """Writes a folder; its rows and bounds are observed meanwhile."""
        at = f"data/{name}/{uuid.uuid4().hex}"
        zones = [f.name for f in df.schema if isinstance(f.dataType, ZONED)]
        seen = Observation()
        bounds = [x for c in zones for x in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))]
        self._filtered(df.observe(seen, F.count("*").alias("rows"), *bounds).hint("rebalance"), keys).parquet(f"{self.home}/{at}")
        got = seen.get
        return {"at": at, "rows": got["rows"], "zones": {c: [_text(got[f"min_{c}"]), _text(got[f"max_{c}"])] for c in zones if got["rows"]}}

    def _put_parts(self, name: str, df: DataFrame, keys: Iterable[str] = ()) -> dict[str, Piece]:
        """Writes df in folders by its column PART; counts and bounds come from those columns of what was written."""
        at = f"data/{name}/{uuid.uuid4().hex}"
        self._filtered(df.hint("rebalance", PART), keys).partitionBy(PART).parquet(f"{self.home}/{at}")
        zones = [f.name for f in df.schema if isinstance(f.dataType, ZONED)]
        schema = T.StructType([*(f for f in df.schema if f.name != PART), T.StructField(PART, T.StringType())])
        written = self.spark.read.schema(schema).parquet(f"{self.home}/{at}")
        bounds = [x for c in zones for x in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))]
        return {
            r[PART]: {"at": f"{at}/{PART}={r[PART]}", "rows": r["_rows"], "zones": {c: [_text(r[f"min_{c}"]), _text(r[f"max_{c}"])] for c in zones}}
            for r in written.groupBy(PART).agg(F.count("*").alias("_rows"), *bounds).collect()  # a row a part
        }

    # reading

    @staticmethod
    def _pieces(entry: Entry) -> list[Piece]:
        return [entry["whole"]] if "whole" in entry else [*entry["parts"].values(), *entry.get("deltas", [])]

    @staticmethod
    def _may_hold(piece: Piece, where: dict[str, tuple]) -> bool:
        """Whether rows with every column of `where` between its bounds (None: open) may be there."""
        if not piece["rows"]:
            return False
        for c, (low, high) in where.items():
            if c in piece["zones"]:
                least, most = piece["zones"][c]
                if least is None or (low is not None and most < low) or (high is not None and least > high):
                    return False
        return True

    def _load(self, entry: Entry, pieces: list[Piece]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        return self.spark.read.schema(schema).parquet(*(f"{self.home}/{p['at']}" for p in pieces)) if pieces else self.spark.createDataFrame([], schema)

    def open(self, entry: Entry, where: dict[str, tuple] | None = None) -> DataFrame:
        """An entry's rows. `where` (column to its bounds, both included, None: open; times as text) only says which folders needn't be
        read; the caller filters rows."""
        entry = entry.get("entry", entry)  # staged ones too
        if "whole" in entry:
            return self._load(entry, [entry["whole"]])
        where = where if where and (not entry.get("deltas") or entry.get("rule") in ("last", None)) else {}
        base = [p for p in entry["parts"].values() if self._may_hold(p, where)]
        deltas = [d for d in entry.get("deltas", []) if d["rows"]]
        if not deltas:
            return self._load(entry, base)
        if not entry["key"]:
            return self._load(entry, [*base, *deltas])
        columns = [f["name"] for f in json.loads(entry["schema"])["fields"]]
        news = [self.spark.read.schema(T.StructType([*T.StructType.fromJson(json.loads(entry["schema"])), T.StructField(GONE, T.BooleanType())])).parquet(f"{self.home}/{d['at']}").withColumn(GONE, F.coalesce(GONE, F.lit(False))) for d in deltas]
        return fold(self._load(entry, base) if base else None, news, entry["key"], entry["rule"], columns)

    def open_parts(self, entry: Entry, parts: Iterable[str]) -> DataFrame:
        """The rows of some parts of a table kept in parts."""
        entry = entry.get("entry", entry)
        return self._load(entry, [p for k in parts if (p := entry["parts"].get(k))])

    def find(self, entry: Entry, parts: Iterable[str], key: str, wanted: DataFrame) -> DataFrame:
        """The rows of some parts whose key is among those of `wanted`. Up to MOST_KEYS of them are given to the scan, which leaves out
        row groups by their filters and bounds; more are joined."""
        rows = self.open_parts(entry, parts)
        keys = [r[0] for r in wanted.select(key).distinct().limit(MOST_KEYS + 1).collect()]
        if len(keys) > MOST_KEYS:
            return rows.join(wanted.select(key), key, "left_semi")
        self.spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", MOST_KEYS)
        return rows.filter(F.col(key).isin([k for k in keys if k is not None]))

    def read(self, table: str, version: int | None = None, where: dict[str, tuple] | None = None) -> DataFrame | None:
        entry = self.manifest(version).get(table)
        return None if not entry else self.open(entry, where)

    def rows(self, entry: Entry | None) -> int | None:
        """How many rows an entry has, if its manifest tells: not for a log with deltas."""
        entry = entry and entry.get("entry", entry)
        if not entry or (entry.get("deltas") and entry["key"]):
            return None
        return sum(p["rows"] for p in self._pieces(entry))

    def bounds(self, entry: Entry | None, column: str) -> tuple | None:
        """(least, greatest) of a column, times as text, if the manifest tells; None for an empty table or where it doesn't tell."""
        entry = entry and entry.get("entry", entry)
        if not entry or (entry.get("deltas") and entry["key"]):
            return None
        zones = [z for p in self._pieces(entry) if p["rows"] and (z := p["zones"].get(column)) and z[0] is not None]
        return (min(z[0] for z in zones), max(z[1] for z in zones)) if zones else None

    # staging

    def stage(self, tables: dict[str, DataFrame]) -> Staged:
        """Writes new versions, whole, that no reader sees yet. They may be published only over the versions they were staged beside."""
        base = self.manifest()
        return {n: {"entry": {"schema": df.schema.json(), "whole": self._put(n, df)}, "base": base.get(n)} for n, df in tables.items()}

    def stage_rows(self, name: str, rows: DataFrame, key: list[str], rule: str = "last", gone: DataFrame | None = None) -> Staged:
        """Writes rows (one a key) to a log, and tombstones for the keys in `gone`; nothing of the table is read. A table without key
        keeps all rows."""
        entry = self.manifest().get(name)
        if entry and ("deltas" not in entry or (entry["key"], entry["rule"]) != (key, rule)):
            raise ValueError(f"{name} is kept in another way")
        written = rows if gone is None else rows.withColumn(GONE, F.lit(False)).unionByName(gone.select(*key, F.lit(True).alias(GONE)), allowMissingColumns=True)
        piece = self._put(name, written, key)
        start = entry or {"schema": rows.schema.json(), "key": key, "rule": rule, "parts": {}, "deltas": []}
        return {name: {"entry": start | {"deltas": [*start["deltas"], piece]}, "base": entry, "added": [piece]}}

    def stage_merge(self, name: str, incoming: DataFrame, part: Column, merge: Callable[[DataFrame, DataFrame], DataFrame], also: Iterable[str] = (), keys: Iterable[str] = ()) -> Staged:
        """Writes new versions of the parts of a table that incoming rows fall in: what `merge` makes of those parts and the rows.

        `part` gives a row's part, letters, digits and hyphens only, few in number; `also` names parts that have to be merged too; the
        files get a filter for each of `keys`. A merge must leave stored rows in their part."""
        rows = incoming.withColumn(PART, part).persist()
        hit = {r[0] for r in rows.select(PART).distinct().collect()} | set(also)  # parts are few
        if bad := [x for x in hit if not x or not x.replace("-", "").isalnum()]:
            raise ValueError(f"no names of parts: {bad[:3]}")
        base = self.manifest().get(name)
        entry = base or {"schema": incoming.schema.json(), "parts": {}}
        if "parts" not in entry or "deltas" in entry:
            raise ValueError(f"{name} is kept in another way")
        if hit:
            old = [p for k, p in entry["parts"].items() if k in hit]
            new = merge(self._load(entry, old), rows.drop(PART)) if old else rows.drop(PART)
            written = self._put_parts(name, new.withColumn(PART, part), keys)
            entry = entry | {"parts": {k: p for k, p in entry["parts"].items() if k not in hit} | written}
        rows.unpersist()
        return {name: {"entry": entry, "base": base, "touched": sorted(hit)}}

    def stage_compaction(self, name: str, most_rows: int = MOST_ROWS) -> Staged:
        """Folds a log's deltas into the parts that their keys fall in; parts of more than `most_rows` are split by further bits of the
        hash, as often as needed. The other parts stay as they are. Deltas that come meanwhile stay on top."""
        base = self.manifest().get(name)
        if not base or not base.get("deltas"):
            return {}
        if not base["key"]:  # rows that are only added become one more part
            more = {f"p{len(base['parts'])}": self._put(name, self._load(base, base["deltas"]))}
            return {name: {"entry": base | {"parts": base["parts"] | more, "deltas": []}, "base": base, "replaced": base["deltas"]}}
        bits = hash_bits(base["key"])
        schema = T.StructType.fromJson(json.loads(base["schema"]))
        keys = self.spark.read.schema(schema).parquet(*(f"{self.home}/{d['at']}" for d in base["deltas"]))
        depth = max((len(p) - 1 for p in base["parts"]), default=0)
        fallen = {r[0]: r[1] for r in keys.groupBy(F.substring(bits, 1, depth) if depth else F.lit("")).count().collect()}  # a row a part at most
        held = {p[1:]: piece for p, piece in base["parts"].items()} or {"": None}
        hit = {p: n for p in held if (n := sum(c for b, c in fallen.items() if b.startswith(p)))}
        cuts = {}
        for p, n in hit.items():
            rows, more = n + (held[p]["rows"] if held[p] else 0), 0
            while rows >> more > most_rows and len(p) + more < BITS:
                more += 1
            cuts[p] = more
        named = F.lit(None).cast("string")
        for more in sorted(set(cuts.values())):  # a branch for each length of prefix
            for length in sorted({len(p) for p, m in cuts.items() if m == more}):
                own = [p for p, m in cuts.items() if m == more and len(p) == length]
                mine = F.substring(bits, 1, length).isin(own) if length else F.lit(True)
                named = F.when(mine, F.concat(F.lit("p"), F.substring(bits, 1, length + more) if length + more else F.lit(""))).otherwise(named)
        touched = base | {"parts": {f"p{p}": held[p] for p in hit if held[p]}}
        written = self._put_parts(name, self.open(touched).withColumn(PART, named), base["key"])
        parts = {k: v for k, v in base["parts"].items() if k[1:] not in hit} | written
        for p, more in cuts.items():  # the prefixes of a split stay complete, empty parts included
            for i in range(1 << more):
                label = "p" + p + (f"{i:0{more}b}" if more else "")
                parts.setdefault(label, {"at": None, "rows": 0, "zones": {}})
        replaced = [*base["deltas"], *(held[p] for p in hit if held[p])]
        return {name: {"entry": base | {"parts": parts, "deltas": []}, "base": base, "replaced": replaced}}

    def due(self, entry: Entry) -> bool:
        """Whether a log has so many deltas, or so large ones, that they should be folded in."""
        if not entry.get("deltas"):
            return False
        small, large = sum(d["rows"] for d in entry["deltas"]), sum(p["rows"] for p in entry["parts"].values())
        return len(entry["deltas"]) > MOST_DELTAS or small > max(MOST_SHARE * large, 100_000)

    def compact(self, names: list[str] | None = None, force: bool = False, most_rows: int = MOST_ROWS) -> list[str]:
        """Compacts the logs that are due (or all named, by force), each in a commit of its own; gives their names. One that another
        compaction came before is left to it; repeating does nothing more."""
        done = []
        for name, entry in self.manifest().items():
            if (names is None or name in names) and (self.due(entry) or force and entry.get("deltas")):
                try:
                    self.publish(self.stage_compaction(name, most_rows))
                    done.append(name)
                except Conflict:
                    continue
        return done

    # publication

    @staticmethod
    def _rebased(name: str, change: dict, now: Entry | None) -> Entry:
        """A change put on what the table has become since it was staged."""
        entry, base = change["entry"], change["base"]
        if now == base:
            return entry
        if "added" in change and (now is None or (now.get("key"), now.get("rule")) == (entry["key"], entry["rule"])):
            start = now or entry | {"deltas": []}
            return start | {"deltas": [*start["deltas"], *change["added"]]}
        if "replaced" in change and now is not None and "deltas" in now:
            have = [*now["parts"].values(), *now["deltas"]]
            if now["parts"] == base["parts"] and all(p in have for p in change["replaced"]):
                return entry | {"deltas": [d for d in now["deltas"] if d not in change["replaced"]]}
        if "touched" in change and now is not None and "parts" in now:
            before = base["parts"] if base else {}
            if all(now["parts"].get(p) == before.get(p) for p in change["touched"]):
                own = {p: piece for p, piece in entry["parts"].items() if p in change["touched"]}
                return now | {"parts": {p: x for p, x in now["parts"].items() if p not in change["touched"]} | own}
        raise Conflict(f"{name} has been changed by another commit")

    def publish(self, staged: Staged) -> int:
        """Makes staged tables the current ones, all together, on top of what has been published since they were staged; `Conflict` if
        that replaced what they were made from."""
        if not staged:
            return self.version()
        while True:
            version = self.version()
            now = self.manifest(version)
            tables = now | {n: self._rebased(n, change, now.get(n)) for n, change in staged.items()}
            draft = f"manifests/.{uuid.uuid4().hex}"
            self._write(draft, json.dumps(tables, sort_keys=True))
            if self._claim(draft, f"manifests/{version + 1:012d}.json"):
                return version + 1

    def commit(self, tables: dict[str, DataFrame]) -> int:
        return self.publish(self.stage(tables))

    def retried(self, work: Callable[[], Staged], times: int = 5) -> int:
        """Publishes what `work` stages; where another commit came first, it is staged again."""
        for k in range(times):
            try:
                return self.publish(work())
            except Conflict:
                if k == times - 1:
                    raise
        raise AssertionError

    def vacuum(self, keep: int = 10, age: float = 7 * 86_400.0) -> list[str]:
        """Deletes the folders that none of the newest `keep` manifests names, and the older manifests; gives the folders' names. Only
        what is older than `age` seconds goes, so that what other commits have staged stays."""
        version = self.version()
        kept = set()
        for v in range(max(1, version - keep + 1), version + 1):
            kept |= {p["at"].split("/")[2] for e in self.manifest(v).values() for p in self._pieces(e) if p["at"]}
        old = self._now() - age
        gone = []
        tables = self._fs.listStatus(self._path("data")) if self._fs.exists(self._path("data")) else []
        for table in tables:
            for folder in self._fs.listStatus(table.getPath()):
                name = folder.getPath().getName()
                if name not in kept and folder.getModificationTime() / 1000 <= old:
                    self._fs.delete(folder.getPath(), True)
                    gone.append(f"data/{table.getPath().getName()}/{name}")
        for v in range(1, version - keep + 1):
            path = self._path(f"manifests/{v:012d}.json")
            if self._fs.exists(path) and self._fs.getFileStatus(path).getModificationTime() / 1000 <= old:
                self._fs.delete(path, False)
        return gone

    # signs of life

    def _now(self) -> float:
        """The time by the store's own clock."""
        probe = f"leases/.{uuid.uuid4().hex}"
        self._write(probe, "")
        now = self._modified(probe)
        self._fs.delete(self._path(probe), False)
        return now

    def _modified(self, name: str) -> float | None:
        path = self._path(name)
        return self._fs.getFileStatus(path).getModificationTime() / 1000 if self._fs.exists(path) else None

    def alive(self, run_id: str) -> bool:
        """Whether a run has given a sign of life lately, by the store's own clock."""
        seen = self._modified(f"leases/{run_id}")
        return seen is not None and self._now() - seen < DEAD

    @contextmanager
    def lease(self, run_id: str, beat: float = BEAT) -> Iterator[None]:
        """Gives signs of life of a run until the block ends."""
        name, ended = f"leases/{run_id}", threading.Event()

        def keep() -> None:
            while not ended.wait(beat):
                self._write(name, "")

        self._write(name, "")
        thread = threading.Thread(target=keep, daemon=True)
        thread.start()
        try:
            yield
        finally:
            ended.set()
            thread.join()
            self._fs.delete(self._path(name), False)
