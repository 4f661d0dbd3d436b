"""The persisted index: segments of documents and postings, laid out for pruning and kept up by commits.

A commit writes what is new as one segment, and the paths that it takes from older segments as a short list;
a manifest, made last, names the live segments and lists and holds the counts that ranking needs. So a
commit costs what its changes cost, and readers always see whole commits. Segments of like size are merged
when there are many, which rewrites each document a logarithmic number of times.
"""

from __future__ import annotations

import json
import threading
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import bound, tokens
from quern.operators.snapshot import parents, surviving_adds
from quern.plans import query as Q
from quern.plans.search import KEYS, Measured, _with_parts
from quern.schema import DOCS
from quern.session import delete, forget, written

FIELDS = {"path": "path", "filename": "filename", "dir": "dir", "content": "text"}
#: Segments of one size class that are merged; a class spans a factor of as many documents.
MERGE_AT = 8
#: Paths and directories of a batch that are looked up by pushed-down filters; more are joined.
FEW_PATHS, FEW_DIRS = 1_000, 50
#: Bytes of text, and documents, that one sorted partition of a segment holds: its documents, or its postings (about eight times the text in memory).
#: So a sort stays in memory whatever the index's size, and the number of partitions follows the index, not the session's settings.
DOC_BYTES, POSTING_BYTES, PART_DOCS = 16 << 20, 8 << 20, 50_000
#: Manifests whose files are kept for readers that still hold them.
KEEP = 2


def term_lists(words: Column) -> Column:
    """array of (term, positions) of the distinct words, by sorting them inside the row."""
    pairs = F.sort_array(F.transform(words, lambda t, i: F.struct(t.alias("term"), i.cast("int").alias("at"))))

    def grouped(s: Column) -> Column:
        places = F.transform(s, lambda x: x["at"])
        opens = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i - 1)["term"] != F.get(s, i)["term"]))
        one = lambda at, firsts: F.transform(firsts, lambda b, j: F.struct(F.get(s, b)["term"].alias("term"), F.slice(at, b + 1, F.coalesce(F.get(firsts, j + 1), F.size(s)) - b).alias("positions")))
        return bound(places, lambda at: bound(opens, lambda firsts: one(at, firsts)))

    return F.when(F.size(words) > 0, bound(pairs, grouped)).otherwise(F.array().cast("array<struct<term:string,positions:array<int>>>"))


def term_table(docs: DataFrame) -> DataFrame:
    """path and, for each text field, the number of its tokens with the list of distinct ones: all that an index needs of a text, tokenised once."""
    one = lambda c: bound(tokens(F.coalesce(F.col(c), F.lit(""))), lambda w: F.struct(F.size(w).alias("dl"), term_lists(w).alias("terms")))
    return docs.select("path", *(one(c).alias(f"w_{f}") for f, c in FIELDS.items()))


def _postings(lists: DataFrame) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"w_{f}").alias("w")) for f in FIELDS))).alias("e")
    rows = lists.select("path", each).select("path", "e.field", "e.w.dl", F.explode("e.w.terms").alias("t"))
    return rows.select("field", "t.term", "path", "dl", "t.positions")


def postings(docs: DataFrame) -> DataFrame:
    """(field, term, path, dl, positions) for every distinct token of every text field; dl: tokens of the field. No shuffle."""
    return _postings(term_table(docs))


def lengths(docs: DataFrame) -> DataFrame:
    """path with dl_<field>: tokens of each field."""
    return docs.select("path", *(F.size(tokens(F.coalesce(F.col(c), F.lit("")))).alias(f"dl_{f}") for f, c in FIELDS.items()))


def term_stats(docs: DataFrame, field: str = "content") -> DataFrame:
    """(term, df, cf) of one field, documents and occurrences; a row per document and term is counted inside the document first."""
    lists = F.explode(term_lists(tokens(F.coalesce(F.col(FIELDS[field]), F.lit(""))))).alias("t")
    return docs.select(lists).groupBy("t.term").agg(F.count("*").alias("df"), F.sum(F.size("t.positions")).alias("cf"))


_SCHEMAS = {
    "docs": DOCS,
    "fresh": DOCS,
    "postings": T.StructType([T.StructField("term", T.StringType()), T.StructField("path", T.StringType()), T.StructField("dl", T.IntegerType()), T.StructField("positions", T.ArrayType(T.IntegerType())), T.StructField("field", T.StringType())]),
    "lengths": T.StructType([T.StructField("path", T.StringType()), *(T.StructField(f"dl_{f}", T.IntegerType()) for f in FIELDS)]),
}


@dataclass
class Manifest:
    """segments: [number, documents] of each; gone: numbers of the lists of paths taken from older segments."""

    number: int = 0
    segments: list[list[int]] = field(default_factory=list)
    gone: list[int] = field(default_factory=list)
    docs: int = 0
    lengths: dict[str, int] = field(default_factory=lambda: dict.fromkeys(FIELDS, 0))

    def files(self) -> set[str]:
        return {f"seg-{n:08d}" for n, _ in self.segments} | {f"gone-{n:08d}" for n in self.gone}


class IndexStore:
    """An index under one root, in any file system that Spark reaches. One writer, any number of readers."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._lock = threading.RLock()

    @classmethod
    def build(cls, docs: DataFrame, root: str) -> IndexStore:
        """A new index of docs, in place of what was at root."""
        store = cls(docs.sparkSession, root)
        delete(store.spark, root)
        store.add(docs)
        return store

    # --- files -----------------------------------------------------------------------------------

    def _fs(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        return hadoop.Path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop.Path

    def _names(self) -> list[str]:
        fs, path = self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(path(self.root))) if fs.exists(path(self.root)) else []

    def versions(self) -> list[int]:
        return [int(n[9:-5]) for n in self._names() if n.startswith("manifest-") and n.endswith(".json")]

    def _load(self, number: int) -> Manifest:
        fs, path = self._fs()
        stream = fs.open(path(f"{self.root}/manifest-{number:08d}.json"))
        try:
            return Manifest(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def manifest(self) -> Manifest:
        """The last commit; an empty one if there is none."""
        found = self.versions()
        return self._load(found[-1]) if found else Manifest()

    def _commit(self, m: Manifest) -> None:
        """Write the manifest under another name, move it into place, and delete what no kept manifest names."""
        fs, path = self._fs()
        target = f"{self.root}/manifest-{m.number:08d}.json"
        out = fs.create(path(target + ".new"), True)
        out.write(bytearray(json.dumps(m.__dict__).encode()))
        out.close()
        if not fs.rename(path(target + ".new"), path(target)):
            raise OSError(f"{target} is there already: another writer is at work")
        kept = [self._load(n) for n in self.versions()[-KEEP:]]
        live = set().union(*(k.files() for k in kept)) | {f"manifest-{k.number:08d}.json" for k in kept}
        for name in self._names():
            if name not in live and name.startswith(("seg-", "gone-", "manifest-")):
                fs.delete(path(f"{self.root}/{name}"), True)

    # --- reading ---------------------------------------------------------------------------------

    def _segment(self, number: int, table: str) -> DataFrame:
        return self.spark.read.schema(_SCHEMAS[table]).parquet(f"{self.root}/seg-{number:08d}/{table}")

    def live(self, table: str, m: Manifest | None = None, where: Column | None = None, only: list[int] | None = None) -> DataFrame:
        """docs, postings or lengths of the live documents; where goes down to the files."""
        m = m or self.manifest()
        out = self.spark.createDataFrame([], _SCHEMAS[table])
        for number, _ in m.segments:
            if only is not None and number not in only:
                continue
            rows = self._segment(number, table)
            rows = rows if where is None else rows.where(where)
            later = [f"{self.root}/gone-{n:08d}" for n in m.gone if n > number]
            if later:
                rows = rows.join(self.spark.read.schema("path string").parquet(*later), "path", "left_anti")
            out = out.unionByName(rows)
        return out

    @property
    def docs(self) -> DataFrame:
        return self.live("docs")

    # --- writing ---------------------------------------------------------------------------------

    def add(self, docs: DataFrame) -> None:
        """Documents whose paths the index does not have."""
        self._write(docs, None)

    def apply(self, changes: DataFrame, fresh: DataFrame) -> bool:
        """Apply changes in order of seq, as snapshot.apply_changes does; fresh: the current document of each
        touched path that still can be read. Returns whether anything was committed."""
        with self._lock:
            m = self.manifest()
            named = changes.where("kind in ('Deleted', 'Modified')").select("path").distinct()
            dirs = changes.where("kind = 'DeletedDir'").select("path").distinct()
            few, few_dirs = [r[0] for r in named.limit(FEW_PATHS + 1).collect()], [r[0] for r in dirs.limit(FEW_DIRS + 1).collect()]
            if len(few) <= FEW_PATHS and len(few_dirs) <= FEW_DIRS:
                hit = F.col("path").isin(few)
                for d in few_dirs:
                    hit = hit | F.col("path").startswith(f"{d}/")
                removed = self.live("lengths", m, hit)
            else:
                rows = self.live("lengths", m)
                above = rows.select("path", F.explode(parents(F.col("path"))).alias("above")).join(dirs.withColumnRenamed("path", "above"), "above", "left_semi").select("path")
                removed = rows.join(named.union(above).distinct(), "path", "left_semi")
            # Written, so that its size is known before the join: few paths are broadcast, and no text is shuffled for none or few.
            adds = written(surviving_adds(changes).select("path"), "adds")
            try:
                return self._write(fresh.limit(0) if adds.isEmpty() else fresh.join(adds, "path", "left_semi"), removed)
            finally:
                forget(adds)

    def _write(self, docs: DataFrame, removed: DataFrame | None) -> bool:
        with self._lock:
            m = self.manifest()
            m.number += 1
            seg, gone = f"{self.root}/seg-{m.number:08d}", f"{self.root}/gone-{m.number:08d}"
            # Written as it comes: what follows reads it several times, and converting files is dear.
            docs.select(*DOCS.fieldNames()).write.mode("overwrite").parquet(f"{seg}/fresh")
            self._write_tables(self._segment(m.number, "fresh"), None, seg)
            delete(self.spark, f"{seg}/fresh")
            totals = [F.count("*").alias("n"), *(F.coalesce(F.sum(f"dl_{f}"), F.lit(0)).alias(f) for f in FIELDS)]
            new, old = self._segment(m.number, "lengths").agg(*totals).first(), None
            if removed is not None and m.segments:
                removed.write.mode("overwrite").parquet(gone)
                old = self.spark.read.schema(_SCHEMAS["lengths"]).parquet(gone).agg(*totals).first()
            taken = old["n"] if old else 0
            if not new["n"] and not taken and m.number > 1:
                delete(self.spark, seg)
                delete(self.spark, gone)
                return False
            m.segments += [[m.number, new["n"]]] if new["n"] else []
            m.gone += [m.number] if taken else []
            m.docs += new["n"] - taken
            for f in FIELDS:
                m.lengths[f] += new[f] - (old[f] if old else 0)
            self._commit(m)
            self._merge(m)
            return True

    @staticmethod
    def _parts(docs: DataFrame) -> tuple[int, int]:
        """Partitions that docs, and their postings, are sorted in."""
        n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        few = min(docs.sparkSession.sparkContext.defaultParallelism, size >> 20)  # so that all cores have work, but none less than 1 MB
        return tuple(max(1 + size // most, 1 + n // PART_DOCS, few) for most in (DOC_BYTES, POSTING_BYTES))

    def _write_tables(self, docs: DataFrame, made: tuple[DataFrame, DataFrame] | None, seg: str) -> None:
        """Documents, postings and lengths of a segment; made: the latter two, where they are there already."""
        parts, finer = self._parts(docs)
        docs.repartitionByRange(parts, "path").sortWithinPartitions("path").write.mode("overwrite").parquet(f"{seg}/docs")
        # The range sort reads its rows twice, for bounds and for itself, so what tokenising gives is written once.
        lists = f"{seg}/lists"
        if made is None:
            found = term_table(self.spark.read.schema(DOCS).parquet(f"{seg}/docs"))
            found.write.mode("overwrite").option("compression", "zstd").parquet(lists)
            found = self.spark.read.schema(found.schema).parquet(lists)
            made = _postings(found), found.select("path", *(F.col(f"w_{f}.dl").alias(f"dl_{f}") for f in FIELDS))
        rows, own = made
        rows = rows.repartitionByRange(finer, "field", "term", "path").sortWithinPartitions("field", "term", "path")
        rows.write.mode("overwrite").partitionBy("field").parquet(f"{seg}/postings")
        own.repartitionByRange(1 + parts // 8, "path").sortWithinPartitions("path").write.mode("overwrite").parquet(f"{seg}/lengths")
        delete(self.spark, lists)

    def _merge(self, m: Manifest) -> None:
        """Merge segments as long as some size class has MERGE_AT of them."""
        while True:
            classes: dict[int, list[int]] = {}
            for number, docs in m.segments:
                classes.setdefault((max(docs, 1).bit_length() - 1) // 3, []).append(number)
            many = next((c for c in classes.values() if len(c) >= MERGE_AT), None)
            if many is None:
                return
            m = Manifest(**json.loads(json.dumps(m.__dict__)))
            before = Manifest(**json.loads(json.dumps(m.__dict__)))
            m.number += 1
            seg = f"{self.root}/seg-{m.number:08d}"
            self._write_tables(self.live("docs", before, only=many), (self.live("postings", before, only=many), self.live("lengths", before, only=many)), seg)
            left = [s for s in m.segments if s[0] not in many]
            m.segments = left + [[m.number, self._segment(m.number, "lengths").count()]]
            m.gone = [g for g in m.gone if any(n < g for n, _ in left)]
            self._commit(m)

    # --- ranking ---------------------------------------------------------------------------------

    def read_postings(self, leaves: list[Q.Leaf], m: Manifest | None = None) -> DataFrame:
        """The live postings of the leaves' terms: of each segment, the files of their fields, the row groups of their terms."""
        wanted = sorted({(x.field, t) for x in leaves for t in x.terms})
        some = F.lit(False)
        for f in sorted({f for f, _ in wanted}):
            some = some | ((F.col("field") == f) & F.col("term").isin([t for g, t in wanted if g == f]))
        return self.live("postings", m, some)

    def measure(self, docs: DataFrame, tree: Q.Node) -> Measured:
        """As search.scan, from the postings of the query's terms; phrases by their positions.

        A query that only documents with one of its terms can match never looks at other documents; their
        names, sizes and times are joined to what matches (`keys`), or before, where the query asks for them.
        """
        m = self.manifest()
        leaves = _with_parts(Q.leaves(tree))
        text, raw = [x for x in leaves if x.field not in Q.RAW_FIELDS], [x for x in leaves if x.field in Q.RAW_FIELDS]
        keys = self.live("docs", m).select(*KEYS)
        df: dict[Q.Leaf, int] = {}
        rows, keyed = keys, True
        if text:
            own = self.read_postings(text, m)
            counted = {(r["field"], r["term"]): r["n"] for r in own.groupBy("field", "term").agg(F.count("*").alias("n")).collect()}  # a row for each term asked for
            df = {x: counted.get((x.field, x.terms[0]), 0) for x in text if len(x.terms) == 1}
            at: dict[tuple[str, str], str] = {}
            for x in text:
                for t in x.terms:
                    at.setdefault((x.field, t), f"p_{len(at)}")
            fields = sorted({x.field for x in text})
            per_path = own.groupBy("path").agg(
                *(F.max(F.when((F.col("field") == f) & (F.col("term") == t), F.col("positions"))).alias(c) for (f, t), c in at.items()),
                *(F.coalesce(F.max(F.when(F.col("field") == f, F.col("dl"))), F.lit(0)).alias(f"dl_{f}") for f in fields),
            )
            keyed = bool(raw) or not needs_terms(tree) or has_range(tree)
            rows = per_path if not keyed else keys.join(per_path, "path", "inner" if needs_terms(tree) else "left")
            cols = []
            for i, x in enumerate(leaves):
                if x.field in Q.RAW_FIELDS:
                    continue
                places = [F.coalesce(F.col(at[x.field, t]), F.array().cast("array<int>")) for t in x.terms]
                cols.append(F.size(F.filter(places[0], self._followed(x, places))).alias(f"tf_{i}"))
            dl = [F.coalesce(F.col(f"dl_{f}"), F.lit(0)).alias(f"dl_{f}") for f in fields]
            rows = rows.select(*(KEYS if keyed else ["path"]), *dl, *cols)
        if raw:
            is_in = {x: (F.col("path" if x.field == "path_exact" else x.field) == x.terms[0]) for x in raw}
            got = keys.agg(*(F.count_if(c).alias(f"n_{i}") for i, c in enumerate(is_in.values()))).first()
            df |= {x: got[i] for i, x in enumerate(is_in)}
            for i, x in enumerate(leaves):
                if x in is_in:
                    rows = rows.withColumn(f"tf_{i}", F.coalesce(is_in[x], F.lit(False)).cast("int"))
        return Measured(rows, leaves, m.docs, dict(m.lengths), df, None if keyed else keys)

    @staticmethod
    def _followed(x: Q.Leaf, places: list):
        """Whether the other terms stand after a place of the first one."""

        def near(k: int, p):
            return lambda o: (o == p + k) if not x.slop else ((o > p) & (o < p + len(x.terms) + x.slop))

        def all_near(p):
            ok = F.lit(True)
            for k, other in enumerate(places[1:], 1):
                ok = ok & F.exists(other, near(k, p))
            return ok

        return all_near


def needs_terms(node: Q.Node) -> bool:
    """Whether only documents that hold a term of a text field can match."""
    if isinstance(node, Q.Leaf):
        return node.field not in Q.RAW_FIELDS
    if isinstance(node, Q.Boost):
        return needs_terms(node.clause)
    if isinstance(node, Q.Bool):
        return any(map(needs_terms, node.must)) if node.must else all(map(needs_terms, node.should))
    return isinstance(node, Q.Nothing)


def has_range(node: Q.Node) -> bool:
    if isinstance(node, Q.Boost):
        return has_range(node.clause)
    if isinstance(node, Q.Bool):
        return any(map(has_range, (*node.must, *node.should, *node.must_not)))
    return isinstance(node, Q.Range)
