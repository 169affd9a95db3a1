"""A stored full-text index of stemmed terms, kept in step with its table.

Postings (one row for a term and a row of the table, with the term's places) lie in folders by generation and shard of the term, so
that a search opens only the shards of the words it asks and skips row groups of others. An update writes a generation with the
postings of the changed rows alone and the ids it makes out of date; nothing older is rewritten until `compact` merges all. A
generation counts from when its folder of sums is there, so that an update that broke off, or ran twice, changes nothing.

Terms are runs of ASCII letters, digits and all characters beyond ASCII, A-Z in lower case, stemmed. Rows whose id is null aren't
indexed; a null text has no terms but counts as a row, and each id has one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.functions.stemming import stem
from kelpie.operators.search import bm25_part
from kelpie.plans.storage import stored_at

_TERM = re.compile(rb"[a-z0-9\x80-\xff]+")
#: Bytes of terms in lower case, all others as blanks.
_AS_TERMS = bytes(b if _TERM.match(bytes([b])) else ord(" ") for b in bytes(range(256)).lower())
#: Postings of a term in some rows: their ids, numbers of terms, and places, those of the k-th row up to ends[k]. Without a term: the rows.
_PACKED = "term string, ids array<long>, ns array<int>, ends array<int>, places array<int>"
_POSTING = "id long, term string, places array<int>, n int"


def terms_of(text: str) -> list[str]:
    """The stems of a text in order."""
    return [stem(t.decode(errors="replace")) for t in _TERM.findall(text.encode().lower())]


def _words(texts: list[bytes]) -> tuple[np.ndarray, pa.DictionaryArray]:
    """How many terms each of the texts has that _AS_TERMS has been through, and all terms in order, told apart."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    held = data != ord(" ")
    edges = np.flatnonzero(np.diff(held, prepend=False))
    begins, ends = edges[::2], edges[1::2]
    ns = np.diff(np.searchsorted(begins, np.cumsum([len(t) + 1 for t in texts])), prepend=0)
    offsets = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data[held])])
    return ns, found.dictionary_encode()


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, kind))


def _packed(ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
    """The postings of some rows by term, and a row without a term that has all of these rows."""
    ns, words = _words(texts)
    texts.clear()
    key, size = np.array(ids, np.int64), ns.astype(np.int32)
    stems = pa.array([stem(w.decode(errors="replace")) for w in words.dictionary.to_pylist()], pa.string()).dictionary_encode()
    term = stems.indices.to_numpy()[words.indices.to_numpy()]
    del words
    row = np.repeat(np.arange(len(ns), dtype=np.int32), size)
    place = np.arange(len(term), dtype=np.int32) - np.repeat((np.cumsum(size) - size).astype(np.int32), size)
    order = np.argsort(term, kind="stable").astype(np.int32)
    term, row, place = term[order], row[order], place[order]
    del order
    new_term = np.flatnonzero(np.diff(term, prepend=-1))
    new_row = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    at = np.searchsorted(new_row, new_term)  # where a term's rows begin
    ends = np.append(new_row[1:], len(term))[: len(new_row)] - np.repeat(new_term, np.diff(np.append(at, len(new_row))))
    every = len(new_row) + np.arange(2)[:1]  # the rows themselves come last
    columns = [
        pa.concat_arrays([stems.dictionary, pa.nulls(1, pa.string())]),  # each is there
        _lists(np.concatenate([key[row[new_row]], key]), np.concatenate([at, every]), pa.int64()),
        _lists(np.concatenate([size[row[new_row]], size]), np.concatenate([at, every]), pa.int32()),
        _lists(ends, np.concatenate([at, every]), pa.int32()),
        _lists(place, np.append(new_term, len(place)), pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["term", "ids", "ns", "ends", "places"])


def analysed(docs: DataFrame, id_col: str, text: Column, at_once: int = 1 << 20) -> DataFrame:
    """Packed postings of the rows, those of at most so many words and one text more at once, where the rows were read: no row a posting is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, total = [], [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                ids.append(batch.column(0)[k].as_py())
                texts.append(batch.column(1)[k].as_py().translate(_AS_TERMS))
                blank = np.frombuffer(texts[-1], np.uint8) == ord(" ")
                total += np.count_nonzero(np.diff(blank, prepend=True, append=True)) // 2 + len(texts[-1]) // 128  # words; very long ones are more
                if total >= at_once:
                    yield _packed(ids, texts)
                    ids, texts, total = [], [], 0
            del batch  # before the next one is read
        if ids:
            yield _packed(ids, texts)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text, F.lit("")).cast("binary").alias("text")).filter("id is not null")
    return rows.mapInArrow(count, _PACKED)


def _repacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed postings of rows (term, id, n, places) that come by term."""
    for batch in batches:
        names, places = batch.column("term").to_pylist(), batch.column("places")
        if not names:
            continue
        starts = np.array([k for k, t in enumerate(names) if not k or t != names[k - 1]], np.int64)
        stop = np.cumsum(places.value_lengths().to_numpy(zero_copy_only=False))
        begin = np.where(starts > 0, stop[starts - 1], 0)
        ends = stop - np.repeat(begin, np.diff(np.append(starts, len(names))))
        columns = [pa.array([names[k] for k in starts.tolist()], pa.string()), *(_lists(batch.column(c).to_numpy(zero_copy_only=False), starts, t) for c, t in (("id", pa.int64()), ("n", pa.int32()))), _lists(ends, starts, pa.int32()), _lists(places.flatten().to_numpy(zero_copy_only=False), begin, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["term", "ids", "ns", "ends", "places"])


def unpacked(packed: DataFrame, *kept: str) -> DataFrame:
    """id, term, places and n of packed postings, and the columns kept."""
    before = lambda k: F.coalesce(F.get("ends", k - 1), F.lit(0))
    each = F.transform("ids", lambda x, k: F.struct(x.alias("id"), F.get("ns", k).alias("n"), F.slice("places", before(k) + 1, F.get("ends", k) - before(k)).alias("places")))
    return packed.select("term", *kept, F.explode(each).alias("p")).select("p.id", "term", "p.places", "p.n", *kept)


def counted(packed: DataFrame, *kept: str) -> DataFrame:
    """id, term, c (how often a row has the term) and n of packed postings, and the columns kept; places aren't read."""
    each = F.arrays_zip("ids", "ns", "ends", F.concat(F.array(F.lit(0)), "ends").alias("before"))  # the last has no id
    found = packed.select("term", *kept, F.explode(each).alias("p")).filter("p.ids is not null")
    return found.select(F.col("p.ids").alias("id"), "term", (F.col("p.ends") - F.col("p.before")).alias("c"), F.col("p.ns").alias("n"), *kept)


def _rows(packed: DataFrame, *kept: str) -> DataFrame:
    """id and n of the rows in packed rows without a term."""
    each = F.transform("ids", lambda x, k: F.struct(x.alias("id"), F.get("ns", k).alias("n")))
    return packed.filter("shard = -1").select(*kept, F.explode(each).alias("p")).select("p.id", "p.n", *kept)


@dataclass(frozen=True)
class TextIndex:
    """An index in a folder. `shards` are fixed when it is built; in a compaction a term's postings are dealt to `salts` tasks."""

    spark: SparkSession
    path: str
    shards: int = 16
    salts: int = 4

    def _read(self, kind: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}")

    def sums(self) -> DataFrame:
        """gen, rows and terms of the whole index after each generation."""
        return self._read("sums", "rows long, terms long, gen int")

    def exists(self) -> bool:
        return stored_at(self.spark, f"{self.path}/sums/gen=0/_SUCCESS")

    def shard(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.shards)).cast("int")

    def _write(self, packed: DataFrame, gen: int) -> None:
        """Postings by shard and the rows they are of; one pass over the texts writes both, each task a file for each shard: nothing is shuffled."""
        placed = packed.withColumn("shard", F.when(F.col("term").isNotNull(), self.shard(F.col("term"))).otherwise(-1))
        placed.sortWithinPartitions("shard", "term").write.mode("overwrite").option("parquet.block.size", 8 << 20).option("compression", "zstd").partitionBy("shard").parquet(f"{self.path}/postings/gen={gen}")

    def _live(self, rows: DataFrame, last: int, whole: bool = False) -> DataFrame:
        """Those of the rows that no later generation has made out of date."""
        if last == 0:
            return rows
        gone = self._read("gone", "id long, gen int").filter(F.col("gen").between(1, last)).groupBy("id").agg(F.max("gen").alias("gone"))
        return rows.join(gone, "id", "left").filter("gone is null or gone <= gen").drop("gone")

    def _postings(self, last: int) -> DataFrame:
        return self._read("postings", f"{_PACKED}, gen int, shard int").filter(F.col("gen") <= last)

    def last(self) -> int:
        return self.sums().agg(F.max("gen")).first()[0]

    def build(self, docs: DataFrame, id_col: str, text: Column) -> TextIndex:
        """Write the first generation."""
        self._write(analysed(docs, id_col, text), 0)
        _rows(self._postings(0)).agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/sums/gen=0")
        return self

    def update(self, dirty: DataFrame, docs: DataFrame, id_col: str, text: Column) -> TextIndex:
        """Bring the index in step for the dirty ids (`id`): rows that are new, changed or gone."""
        gen = self.last() + 1
        before = self.sums().filter(F.col("gen") == gen - 1).first()
        dirty.select(F.col("id").cast("long").alias("id")).filter("id is not null").distinct().write.mode("overwrite").parquet(f"{self.path}/gone/gen={gen}")
        ids = self._read("gone", "id long, gen int").filter(F.col("gen") == gen).select("id")
        changed = docs.join(ids, docs[id_col].cast("long") == ids["id"], "left_semi")
        self._write(analysed(changed, id_col, text), gen)
        size = (F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"))
        old = self._live(_rows(self._postings(gen - 1), "gen"), gen - 1).join(ids, "id", "left_semi").agg(*size).first()
        new = _rows(self._postings(gen).filter(F.col("gen") == gen)).agg(*size).first()
        now = [(before[k] - old[k] + new[k]) for k in ("rows", "terms")]
        self.spark.createDataFrame([now], "rows long, terms long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/sums/gen={gen}")
        return self

    def compact(self, path: str) -> TextIndex:
        """The index in one generation, in another folder. Postings are unpacked, and packed anew by term and a hash of the id."""
        last, other = self.last(), TextIndex(self.spark, path, self.shards, self.salts)
        kept = self._live(unpacked(self._postings(last).filter("shard >= 0"), "gen"), last)
        dealt = kept.repartition("term", F.pmod(F.xxhash64("id"), F.lit(self.salts))).sortWithinPartitions("term", "id")
        terms = dealt.select("term", "id", "n", "places").mapInArrow(_repacked, _PACKED)
        parts = F.lit(1 + self.size()[0] // 65536)
        rows = self._live(_rows(self._postings(last), "gen"), last).groupBy(F.pmod(F.xxhash64("id"), parts)).agg(F.collect_list(F.struct("id", "n")).alias("each"))
        none, part = F.array().cast("array<int>"), lambda name: F.transform("each", lambda x: x[name])
        packed = terms.union(rows.select(F.lit(None).cast("string"), part("id"), part("n"), none, none))
        other._write(packed, 0)
        self.sums().filter(F.col("gen") == last).select("rows", "terms").coalesce(1).write.mode("overwrite").parquet(f"{path}/sums/gen=0")
        return other

    def _of(self, terms: list[str] | None, last: int) -> DataFrame:
        """Packed postings of the given stems, or of all."""
        found = self._postings(last).filter("shard >= 0")
        if terms is None:
            return found
        rows = self.spark.createDataFrame([(t,) for t in terms], "term string")
        shards = [r["shard"] for r in rows.select(self.shard(F.col("term")).alias("shard")).distinct().collect()]
        return found.filter(F.col("shard").isin(shards) & F.col("term").isin(terms))

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """id, term, places and n: of the given stems only their shards are read."""
        last = self.last()
        return self._live(unpacked(self._of(terms, last), "gen"), last).select("id", "term", "places", "n")

    def counts(self, terms: list[str] | None = None) -> DataFrame:
        """id, term, c (how often the row has it) and n, without reading places."""
        last = self.last()
        return self._live(counted(self._of(terms, last), "gen"), last).select("id", "term", "c", "n")

    def size(self) -> tuple[int, int]:
        """Rows and terms of the index."""
        found = self.sums().orderBy(F.desc("gen")).first()
        return found["rows"], found["terms"]

    def ranked(self, words: list[str]) -> DataFrame:
        """id and rank of the rows that hold a word's stem; rank is negative, smaller is better. No word gives no rows."""
        asked = list(dict.fromkeys(t for w in words for t in terms_of(w)))
        if not asked:
            return self.spark.createDataFrame([], "id long, rank double")
        rows, terms = self.size()
        found = self.counts(asked)
        held = found.groupBy("term").agg(F.count("*").alias("d"))
        each = found.join(F.broadcast(held), "term")  # a row a word
        part = bm25_part(F.col("c"), F.col("d"), F.lit(rows), F.col("n"), F.lit(terms / rows))
        return each.withColumn("part", part).groupBy("id").agg((-F.sum("part")).alias("rank"))

    def phrases(self, phrases: list[str]) -> DataFrame:
        """id and number of the phrases that a row holds as consecutive stems, rows with none left out. A row's postings of the
        words meet as they are, and of a phrase the places of each word less its place in the phrase are intersected."""
        asked = [p for p in (terms_of(x) for x in phrases) if p]
        if not asked:
            return self.spark.createDataFrame([], "id long, phrases int")
        met = self.postings(sorted({t for p in asked for t in p})).groupBy("id").agg(F.collect_list(F.struct("term", "places")).alias("held"))  # a row's posting of each word
        places = lambda term: F.flatten(F.transform(F.filter("held", lambda x: x["term"] == term), lambda x: x["places"]))

        def held(phrase: list[str]) -> Column:
            begins = [F.transform(places(t), lambda p: p - k) for k, t in enumerate(phrase)]
            return (F.size(reduce(F.array_intersect, begins)) > 0).cast("int")

        return met.select("id", sum((held(p) for p in asked), F.lit(0)).cast("int").alias("phrases")).filter("phrases > 0")

    def commonest(self, docs: DataFrame, id_col: str, text: Column, left_out: list[str], most: int = 5, longer: int = 3) -> list[str]:
        """The commonest stems of a few rows that are longer than `longer` and not among the stems of the words left out."""
        stems = [t for w in left_out for t in terms_of(w)]
        found = unpacked(analysed(docs, id_col, text).filter("term is not null")).filter((F.length("term") > longer) & ~F.col("term").isin(stems))
        return [r["term"] for r in found.groupBy("term").agg(F.sum(F.size("places")).alias("c")).orderBy(F.desc("c"), "term").limit(most).collect()]
