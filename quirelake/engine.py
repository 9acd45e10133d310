"""One entry to the memory on disk: tables in versions, every change a new version, never a write where it is read.

Layout under the root: `pairs/full-v=N` or `pairs/delta-v=N` (path_hash, src_lang, src_checksum, tgt_lang, tgt_checksum,
ord) and the same of `store` (lang, path_hash, checksum, text), partitioned by lang.  A delta holds only what is new, so a
commit costs what it adds; after `COMPACT` deltas, and after every deletion, a full version takes their place, and what is
older than the full version before it is removed.  A version counts once its `pairs` are complete, which are written last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions import text
from quirelake.operators import memory, translate

PAIRS = "path_hash string, src_lang string, src_checksum string, tgt_lang string, tgt_checksum string, ord bigint"
STORE = "path_hash string, checksum string, text string, lang string"
KEY = ["path_hash", "src_lang", "tgt_lang", "src_checksum"]
#: deltas after which a full version is written
COMPACT = 16


class ChecksumNotFound(LookupError):
    """A correction of a chunk whose source text is not in the store."""


class Engine:
    """The memory of a project."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- versions

    def _versions(self) -> dict[int, str]:
        """Numbers and kinds of the complete versions."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/pairs/*-v=*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        names = [f.getPath().getParent().getName().split("-v=") for f in found]
        return {int(number): kind for kind, number in names}

    def version(self) -> int:
        """Number of the newest complete version, 0 if there is none."""
        return max(self._versions(), default=0)

    def _read(self, table: str, schema: str) -> DataFrame:
        """The rows of the newest full version and the deltas after it, with `v`."""
        versions = self._versions()
        full = max((n for n, kind in versions.items() if kind == "full"), default=0)
        out = self.spark.createDataFrame([], schema).withColumn("v", F.lit(0))
        for n in sorted(n for n in versions if n >= full):
            one = self.spark.read.schema(schema).parquet(f"{self.root}/{table}/{versions[n]}-v={n}")
            out = out.unionByName(one.withColumn("v", F.lit(n)))
        return out

    def pairs(self) -> DataFrame:
        newest = F.max_by(F.struct("tgt_checksum", "ord"), F.struct("v", "ord", "tgt_checksum")).alias("newest")
        rows = self._read("pairs", PAIRS).groupBy(*KEY).agg(newest)
        return rows.select("path_hash", "src_lang", "src_checksum", "tgt_lang", "newest.tgt_checksum", "newest.ord")

    def store(self) -> DataFrame:
        rows = self._read("store", STORE).groupBy("lang", "path_hash", "checksum").agg(F.min_by("text", "v").alias("text"))
        return rows.select("path_hash", "checksum", "text", "lang")

    def _write(self, kind: str, pairs: DataFrame, store: DataFrame) -> int:
        n = self.version() + 1
        store.select("path_hash", "checksum", "text", "lang").write.mode("overwrite").partitionBy("lang").parquet(f"{self.root}/store/{kind}-v={n}")
        pairs.select(*(p.split()[0] for p in PAIRS.split(", "))).write.mode("overwrite").parquet(f"{self.root}/pairs/{kind}-v={n}")
        return n

    def commit(self, pairs: DataFrame, store: DataFrame) -> int:
        """Writes both tables whole as the next version; what an interrupted commit left there is replaced."""
        before = self._versions()
        n = self._write("full", pairs, store)
        self._purge(max((k for k, kind in before.items() if kind == "full"), default=0))
        return n

    def append(self, pairs: DataFrame, store: DataFrame) -> int:
        """Writes new rows of both tables as the next version."""
        n = self._write("delta", pairs, store)
        versions = self._versions()
        full = max((k for k, kind in versions.items() if kind == "full"), default=0)
        return self.commit(self.pairs(), self.store()) if n - full >= COMPACT else n

    def _purge(self, oldest: int) -> None:
        """Removes the versions before one that a full version has replaced; that one stays for readers under way."""
        conf = self.spark._jsc.hadoopConfiguration()
        for number, kind in self._versions().items():
            if number < oldest:
                for table in ("pairs", "store"):
                    path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}/{kind}-v={number}")
                    path.getFileSystem(conf).delete(path, True)

    # -- use

    def index(self) -> DataFrame:
        """Both directions of all pairs."""
        forward = self.pairs()
        back = forward.select(
            "path_hash", F.col("tgt_lang").alias("src_lang"), F.col("tgt_checksum").alias("src_checksum"), F.col("src_lang").alias("tgt_lang"), F.col("src_checksum").alias("tgt_checksum"), "ord"
        )
        # a pair in its own direction goes before one read backwards
        both = forward.withColumn("own", F.lit(1)).unionByName(back.withColumn("own", F.lit(0)))
        return both.groupBy(*KEY).agg(F.max_by("tgt_checksum", F.struct("own", "ord", "tgt_checksum")).alias("tgt_checksum"))

    def lookup(self, requests: DataFrame) -> DataFrame:
        return memory.lookup(requests, self.index(), self.store())

    def persist(self, pairs: DataFrame) -> int:
        """Adds pairs (path_hash, src_lang, tgt_lang, src_text, tgt_text); checksums are those of the texts, the newest
        pair of a key wins, and doing it twice changes nothing."""
        n = self.version() + 1
        made = pairs.select("path_hash", "src_lang", "tgt_lang", "src_text", "tgt_text", text.checksum(F.col("src_text")).alias("src_checksum"), text.checksum(F.col("tgt_text")).alias("tgt_checksum"))
        texts = [made.select(F.col(f"{side}_lang").alias("lang"), "path_hash", F.col(f"{side}_checksum").alias("checksum"), F.col(f"{side}_text").alias("text")) for side in ("src", "tgt")]
        # the same key twice in one call: the greater checksum, whatever the order of the rows
        new = made.where("src_lang <> tgt_lang").groupBy(*KEY).agg(F.max("tgt_checksum").alias("tgt_checksum")).withColumn("ord", F.lit(n).cast("bigint"))
        known = self.store().select("lang", "path_hash", "checksum")
        fresh = texts[0].unionByName(texts[1]).dropDuplicates(["lang", "path_hash", "checksum"]).join(known, ["lang", "path_hash", "checksum"], "left_anti")
        return self.append(new, fresh)

    def sync(self, sources: DataFrame, targets: DataFrame) -> int:
        """Rebuilds pairs from edited targets: path_hash, src_checksum, src_text, src_lang, ord of the source chunks, and
        path_hash, src_checksum, tgt_text, tgt_lang of the target chunks; targets without a source are left out."""
        lang = sources.select("path_hash", "src_lang").distinct()
        pairs = memory.rebuild_pairs(sources, targets).join(lang, "path_hash")
        return self.persist(pairs.where(F.col("tgt_text").isNotNull()).withColumn("tgt_text", text.strip(F.col("tgt_text"))))

    def correct(self, targets: DataFrame) -> DataFrame:
        """The target chunks (path_hash, src_lang, tgt_lang, src_checksum, tgt_text) that differ from what is recorded, but
        for the white space around them, which a target file does not keep."""
        judged = memory.corresponds(targets.withColumn("tgt_checksum", text.checksum(F.col("tgt_text"))), self.index())
        texts = self.store().select("path_hash", F.col("lang").alias("tgt_lang"), F.col("checksum").alias("recorded_checksum"), F.col("text").alias("recorded_text"))
        known = judged.join(texts, ["path_hash", "tgt_lang", "recorded_checksum"], "left")
        same = F.coalesce(text.strip(F.col("recorded_text")) == text.strip(F.col("tgt_text")), F.lit(False))
        return known.where(~F.col("corresponds") & ~same).drop("recorded_text")

    def record(self, targets: DataFrame) -> int:
        """Records the target chunks that differ from what is recorded; returns their number. The source text of each must
        be in the store."""
        changed = self.correct(targets).select("path_hash", "src_lang", "tgt_lang", "src_checksum", "tgt_text").distinct()
        sources = self.store().select("path_hash", F.col("lang").alias("src_lang"), F.col("checksum").alias("src_checksum"), F.col("text").alias("src_text"))
        found = changed.join(sources, ["path_hash", "src_lang", "src_checksum"], "left")
        lost = found.where("src_text is null").select("src_checksum").first()
        if lost:
            raise ChecksumNotFound(f"no source text for {lost['src_checksum']}")
        n = found.count()
        if n:
            self.persist(found)
        return n

    def clear_checksum(self, checksum: str, lang: str | None = None) -> int:
        """Deletes what belongs to a checksum: as a source, its pairs and their texts (of one language, its target only);
        otherwise as a target."""
        pairs, store = self.pairs(), self.store()
        is_source = pairs.where(F.col("src_checksum") == checksum).limit(1).count() > 0
        own = F.col("src_checksum" if is_source else "tgt_checksum") == checksum
        doomed = pairs.where(own if lang is None else own & (F.col("tgt_lang") == lang))
        texts = doomed.select("path_hash", F.col("tgt_lang").alias("lang"), F.col("tgt_checksum").alias("checksum"))
        if is_source and lang is None:
            texts = texts.unionByName(doomed.select("path_hash", F.col("src_lang").alias("lang"), F.col("src_checksum").alias("checksum")))
        left = pairs.join(doomed.select(*KEY), KEY, "left_anti")
        return self.commit(left, store.join(texts.distinct(), ["path_hash", "lang", "checksum"], "left_anti"))

    def clear(self, lang: str | None = None, path_hash: str | None = None, keyword: str | None = None) -> int:
        """Deletes the texts in scope (a language, a file, a literal keyword) and the pairs that need them."""
        own = {"lang": lang, "path_hash": path_hash}
        scope = F.lit(True)
        for column, value in own.items():
            if value is not None:
                scope = scope & (F.col(column) == value)
        if keyword is not None:
            scope = scope & F.contains("text", F.lit(keyword))
        return self._keep(self.store().where(~F.coalesce(scope, F.lit(False))))

    def clear_missing(self) -> int:
        """Drops pairs of which a text is gone, and texts that no pair needs."""
        return self._keep(self.store())

    def _keep(self, store: DataFrame) -> int:
        pairs = self.pairs()
        for side in ("src", "tgt"):
            there = store.select("path_hash", F.col("lang").alias(f"{side}_lang"), F.col("checksum").alias(f"{side}_checksum")).distinct()
            pairs = pairs.join(there, ["path_hash", f"{side}_lang", f"{side}_checksum"], "left_semi")
        needed = [pairs.select("path_hash", F.col(f"{side}_lang").alias("lang"), F.col(f"{side}_checksum").alias("checksum")) for side in ("src", "tgt")]
        return self.commit(pairs, store.join(needed[0].unionByName(needed[1]).distinct(), ["path_hash", "lang", "checksum"], "left_semi"))

    def translate(self, requests: DataFrame, caller: translate.Caller, out: str) -> DataFrame:
        """Translates requests, stores results and new pairs, then raises if a call was fatal."""
        asked = requests.withColumn("src_checksum", text.checksum(F.col("content")))
        index, store = self.index(), self.store()
        examples = translate.find_examples(asked, index, store)
        translate.translate(asked, index, store, caller, examples).write.mode("overwrite").parquet(out)
        done = self.spark.read.parquet(out)
        made = done.where("outcome in ('translated', 'ph_only')")
        self.persist(made.select("path_hash", "src_lang", "tgt_lang", F.col("content").alias("src_text"), F.col("text").alias("tgt_text")))
        translate.check_fatal(done)
        return done
