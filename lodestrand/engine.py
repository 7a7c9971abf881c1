"""The engine as one object: a versioned mirror, its derived indexes and the five search modes.

Facts (pages, files) and derived tables (documents, postings, code modules, data codes) live in one versioned store. Every
change of facts appends the changed rows with their sequence numbers in one commit; derived tables name the sequence they are good for and the
contract they were made under, and are restored, brought up to date by replaying the rows above that
sequence, or rebuilt. A refresh always equals a full rebuild.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.extract import content_text
from lodestrand.functions.lua import SYMBOLS
from lodestrand.functions.rules import DEFAULT_RULES, Rules, category, first_valid, parse_rules, rule_values
from lodestrand.functions.text import Analyzer
from lodestrand.operators import mirror, search
from lodestrand.operators.index import META, SearchIndex, by_term, live_documents, live_postings, merge_from, superseded
from lodestrand.sources.store import Manifest, Store
from lodestrand.sources.work import materialize

MODES = ("title", "content", "lua", "data", "file")
# fixed values: names and types of a stored row
ROW = {
    "id": "bigint", "title": "string", "normalizedTitle": "string", "namespace": "bigint", "namespaceName": "string", "isRedirect": "boolean", "localSeq": "bigint",
    "deleted": "boolean", "revisionId": "bigint", "contentModel": "string", "content": "string", "contentRevisionId": "bigint",
}
FACTS = ("title", "namespace", "namespaceName", "isRedirect", "deleted", "revisionId", "contentModel", "content", "contentRevisionId")
FORMATS = {"facts": 1, "tokens": 1, "modules": 1, "extraction": 1}


class Engine:
    """A mirror at ``root``. ``rules`` select the searched fields of data pages.

    With ``warm`` the indexes that are searched are kept in the executors' memory (what does not fit, or is lost with an
    executor, is read again), one version of each.
    """

    def __init__(self, spark: SparkSession, root: str, analyzer: Analyzer | None = None, rules: str | None = None, warm: bool = False):
        self.spark, self.analyzer, self.warm = spark, analyzer or Analyzer(), warm
        self._sound: set[str] = set()  # parts whose integrity this engine has checked
        self._kept: dict[str, tuple[list[str], SearchIndex, DataFrame]] = {}
        self.rules: Rules = parse_rules(first_valid([rules, DEFAULT_RULES]))
        self.store = Store(spark, root, {"facts": FORMATS["facts"]})

    # facts

    def parts(self, table: str, manifest: Manifest | None = None) -> DataFrame:
        """All rows ever committed to ``pages`` or ``files``, older states of an id included."""
        found = self.store.read(table, manifest)
        return self.spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in ROW.items())) if found is None else found.select(*ROW)

    @staticmethod
    def latest(parts: DataFrame) -> DataFrame:
        """The last state of every id: commits only append, and later ones have higher sequence numbers.

        Which states are superseded is found on the two columns that decide it; the rows themselves, bodies and all, only
        meet the sequence numbers of those, which are few after a compaction, and only with the columns that are asked for.
        """
        slim = parts.select("id", "localSeq")
        top = slim.groupBy("id").agg(F.max("localSeq").alias("top"))
        old = slim.join(top, "id").where(F.col("localSeq") < F.col("top")).select("localSeq")
        return parts.join(old, "localSeq", "left_anti").select(*ROW)

    def rows(self, table: str = "pages", manifest: Manifest | None = None) -> DataFrame:
        """Stored rows of ``pages`` or ``files``, tombstones included."""
        return self.latest(self.parts(table, manifest))

    def compact(self, table: str = "pages") -> None:
        """Rewrite the parts of a table as one, without older states."""
        self.store.update(lambda base: ({table: self.rows(table, base)}, {}))

    @property
    def sequence(self) -> int:
        """The highest sequence number handed out."""
        return self.store.manifest().state.get("local-sequence", 0)

    def shaped(self, incoming: DataFrame) -> DataFrame:
        """Incoming rows as stored ones, one per id."""
        have = set(incoming.columns)
        rows = incoming.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in ROW.items()])
        name = F.coalesce("namespaceName", F.col("namespace").cast("string"))
        # Of several rows of one id the one of the highest revision counts, of equal ones the greatest in its columns
        own = [c for c in ROW if c != "id"]
        first = F.struct(F.coalesce("revisionId", F.lit(-1)).alias("_rev"), *own)
        rows = rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(first).alias("r")).select("id", *[F.col(f"r.{c}") for c in own])
        return rows.withColumns({
            "normalizedTitle": self.analyzer.normalize(F.col("title")), "namespaceName": name,
            "isRedirect": F.coalesce("isRedirect", F.lit(False)), "deleted": F.coalesce("deleted", F.lit(False)),
        })

    def merged(self, stored: DataFrame, incoming: DataFrame, fence: int | None) -> DataFrame:
        """Incoming rows that change something, in their new form."""
        a, b = incoming.alias("a"), stored.alias("b")
        new = F.col("b.id").isNull()
        stale = F.coalesce(F.col("b.revisionId") > F.col("a.revisionId"), F.lit(False))
        late = F.coalesce(F.col("b.localSeq") > fence, F.lit(False)) if fence is not None else F.lit(False)
        same_body = F.col("a.content").isNull() & F.col("a.revisionId").eqNullSafe(F.col("b.contentRevisionId")) & ~F.col("a.deleted")
        body = lambda c: F.when(same_body, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
        model = F.coalesce(F.col("a.contentModel"), F.col("b.contentModel")).alias("contentModel")
        columns = [body(c) if c in ("content", "contentRevisionId") else model if c == "contentModel" else F.col(f"a.{c}").alias(c) for c in ROW]
        merged = a.join(b, F.col("a.id") == F.col("b.id"), "left").where(new | ~(stale | late)).select(*columns, *[F.col(f"b.{c}").alias(f"old_{c}") for c in FACTS], new.alias("is_new"))
        changed = F.col("is_new")
        for c in FACTS:
            changed = changed | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
        return merged.where(changed).select(*ROW)

    def numbered(self, changed: DataFrame, start: int) -> tuple[DataFrame, int]:
        """Rows with sequence numbers above ``start`` in order of id, and the highest number after."""
        rows = mirror.assign_sequence(changed.drop("localSeq"), ["id"], start).select(*ROW)
        return rows, rows.agg(F.max("localSeq")).first()[0] or start

    def _commit(self, table: str, change, batch: int | None = None) -> int:
        """Append the rows ``change(stored, manifest)`` gives, numbered; returns the sequence after."""

        def apply(base: Manifest) -> tuple:
            start = base.state.get("local-sequence", 0)
            rows, end = self.numbered(change(self.rows(table, base), base), start)
            return ({}, {}) if end == start else ({}, {"local-sequence": end}, {table: rows})

        return self.store.update(apply, batch=batch).state.get("local-sequence", 0)

    def ingest(self, rows: DataFrame, table: str = "pages", batch: int | None = None) -> int:
        """Add or change rows; only real changes take a sequence number. Of several rows of
        one id the one of the highest revision counts."""
        return self._commit(table, lambda stored, _: self.merged(stored, self.shaped(rows), None), batch)

    def remove(self, ids: DataFrame, table: str = "pages", batch: int | None = None) -> int:
        """Tombstones for live rows of the given ids."""
        return self._commit(table, lambda stored, _: mirror.tombstone(search.live(stored).join(ids.select("id"), "id", "left_semi")), batch)

    def reconcile(self, scan: DataFrame, started_at: int, table: str = "pages") -> int:
        """A full scan that began at sequence ``started_at``: repair, add and sweep; later writes are kept."""

        def change(stored: DataFrame, _: Manifest) -> DataFrame:
            shaped = self.shaped(scan)
            gone = mirror.tombstone(mirror.sweep(stored, shaped, F.lit(started_at)))
            return self.merged(stored, shaped, started_at).unionByName(gone.select(*ROW))

        return self._commit(table, change)

    def load_data_codes(self, documents: DataFrame) -> int:
        """Replace the data codes by those of JSON documents (source, json)."""
        code, name = F.get_json_object("json", "$.id"), F.trim(F.get_json_object("json", "$.locales['zh-CN'].name"))
        rows = documents.select("source", code.alias("code"), name.alias("chineseName"), "json").where("source <> '' and code <> '' and chineseName <> ''")
        kind, normal = category(F.col("source")), self.analyzer.normalize
        rows = rows.withColumn("values", rule_values(F.col("json"), F.col("source"), self.rules)).select(
            "source", "code", "chineseName", F.when(kind == "*", "Data").otherwise(kind).alias("dataType"), normal(F.col("chineseName")).alias("normalizedName"),
            normal(F.array_join("values", " ")).alias("normalizedSearchText"), F.transform("values", normal).alias("normalizedSearchValues"),
        )
        state = {"data.key": self._key("data")}
        return sum(self.store.update(lambda _: ({"data": rows.dropDuplicates(["source"])}, state)).counts["data"])

    # derived tables

    def _key(self, kind: str) -> str:
        """What a derived table depends on besides the facts."""
        rules = hashlib.sha256(json.dumps(self.rules, sort_keys=True).encode()).hexdigest()[:32] if kind == "data" else ""
        return f"{kind}:{json.dumps(FORMATS, sort_keys=True)}:{self.analyzer.digest()}:{rules}"

    def _derive(self, kind: str, rows: DataFrame) -> DataFrame:
        """The documents of ``rows`` with their tokens: id, META, text, symbols, seq, tokens."""
        meta, none = ["id", *META], F.lit(None).cast("string").alias("text")
        symbols = F.lit(None).cast(SYMBOLS).alias("symbols")
        live = search.live(rows).withColumn("seq", F.col("localSeq"))
        if kind == "lua":
            docs = materialize(search.lua_documents(live).select(*meta, "text", "symbols", "seq"), "modules").withColumn("source", F.col("text"))
        elif kind == "title":
            docs = live.select(*meta, none, symbols, "seq", F.col("title").alias("source"))
        else:
            body = content_text(F.col("contentModel"), F.col("content"))
            bodies = live.where(~F.coalesce("isRedirect", F.lit(False)) & F.col("content").isNotNull())
            docs = materialize(bodies.select(*meta, body.alias("text"), symbols, "seq"), "extracted").where("text <> ''").withColumn("source", F.col("text"))
        return materialize(docs.withColumn("tokens", self.analyzer.document_tokens(F.col("source"))).drop("source"), "tokens")

    def _terms(self, tokens: DataFrame, *columns: str) -> DataFrame:
        return tokens.select(F.explode_outer("tokens").alias("term"), *columns).where(F.col("term").isNotNull())

    def refresh(self, kind: str, rebuild: bool = False) -> str:
        """Bring a derived table (title, content or lua) up to the facts: current, replayed or rebuilt.

        A replay adds a part with the documents that changed, their postings and what they add to or take from the
        vocabulary; the postings of their older states stay and are left out by their sequence numbers, until parts are merged
        because they have come to a like size. What is written is in proportion to the change, but for these merges.
        """
        done: list[str] = []
        names = kind, f"{kind}.terms", f"{kind}.words"

        def change(base: Manifest) -> tuple:
            through, key = base.state.get("local-sequence", 0), self._key(kind)
            usable = not rebuild and base.state.get(f"{kind}.key") == key and kind in base.tables
            # corrupt: facts are never touched, the index is made again
            usable = usable and all(self._is_sound(n, base) for n in names)
            since = base.state.get(f"{kind}.through", 0)
            done[:] = ["current" if usable and since == through else "replayed" if usable else "rebuilt"]
            if done == ["current"]:
                return {}, {}
            # only rows above the sequence are read for a replay, the filter reaches the scan
            changed = self.latest(mirror.rows_after(self.parts("pages", base), since)) if usable else self.rows("pages", base)
            tokens = self._derive(kind, changed)
            docs = tokens.select("id", *META, F.size("tokens").alias("field_len"), "text", "symbols", "seq", F.lit(False).alias("removed"))
            words = self._terms(tokens).groupBy("term").agg(F.count("*").alias("df"))
            size = tokens.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("length")).first()
            total = [size["n"], size["length"]]
            state = {f"{kind}.through": through, f"{kind}.key": key}
            if not usable:
                return {kind: docs, f"{kind}.terms": by_term(self._terms(tokens, "id", "seq")), f"{kind}.words": by_term(words)}, state | {f"{kind}.total": total}
            # the older states of what changed are analysed again from what is kept of them, the postings are not read
            before = self.documents(kind, base).join(changed.select("id"), "id", "left_semi")
            source = F.col("title") if kind == "title" else F.col("text")
            before = materialize(before.select("id", self.analyzer.document_tokens(source).alias("tokens")), "before")
            less = before.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("length")).first()
            old = base.state[f"{kind}.total"]
            state[f"{kind}.total"] = [old[0] + total[0] - less["n"], old[1] + total[1] - less["length"]]
            gone = before.select("id").join(docs.select("id"), "id", "left_anti").join(changed.select("id", F.col("localSeq").alias("seq")), "id")
            gone = gone.select("id", *[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in (*META, "field_len", "text", "symbols")], "seq", F.lit(True).alias("removed"))
            words = words.unionByName(self._terms(before).groupBy("term").agg((-F.count("*")).alias("df")))
            fresh = {kind: docs.unionByName(gone), f"{kind}.terms": self._terms(tokens, "id", "seq"), f"{kind}.words": words}
            return {}, state, *self._with_merged(kind, base, fresh)

        if rebuild or not self._current(kind) or change(self.store.manifest()) != ({}, {}):
            self.store.update(change)
        return done[0]

    def _current(self, kind: str) -> bool:
        """Whether nothing was committed since a derived table was made, so that no version needs to be."""
        state = self.store.manifest().state
        return state.get(f"{kind}.key") == self._key(kind) and state.get(f"{kind}.through", 0) == state.get("local-sequence", 0)

    def _is_sound(self, name: str, base: Manifest) -> bool:
        """Whether the parts of a table are as they were written; looked at once by each engine."""
        if not self._sound.issuperset(base.tables.get(name, [])):
            if self.store.status(name, 0) != "available":
                return False
            self._sound.update(base.tables[name])
        return True

    def _with_merged(self, kind: str, base: Manifest, fresh: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, int]]:
        """The part to append, with the parts that are due merged into it, and how many parts stay before it.

        Documents, postings and words are merged alike, so that a state and its postings always go together; removed
        documents are forgotten when no older part is left that could hold them.
        """
        fresh[kind] = materialize(fresh[kind], "segment")
        sizes = [*base.counts[kind], fresh[kind].count()]
        keep = merge_from(sizes)
        if keep < len(sizes):
            tail = lambda name: self.spark.read.parquet(*base.tables[name][keep:])
            docs = materialize(self.store.read(kind, base).unionByName(fresh[kind]).select("id", "seq"), "states")
            dead = superseded(docs)
            merged = tail(kind).unionByName(fresh[kind]).join(dead, "seq", "left_anti").select(*fresh[kind].columns)
            terms = tail(f"{kind}.terms").unionByName(fresh[f"{kind}.terms"]).join(dead, "seq", "left_anti").select("term", "id", "seq")
            words = tail(f"{kind}.words").unionByName(fresh[f"{kind}.words"])
            fresh = {kind: merged if keep else merged.where(~F.col("removed")), f"{kind}.terms": terms, f"{kind}.words": words}
        fresh[f"{kind}.words"] = fresh[f"{kind}.words"].groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        sorted_too = {n: by_term(d) if n != kind else d for n, d in fresh.items()}
        return sorted_too, {n: min(keep, len(base.tables[n])) for n in fresh}

    def _segments(self, kind: str, base: Manifest) -> tuple[DataFrame, DataFrame]:
        """Documents of all parts, and those of all but the first."""
        docs = self.store.read(kind, base)
        later = base.tables[kind][1:]
        return docs, self.spark.read.parquet(*later) if later else docs.limit(0)

    def index(self, kind: str) -> SearchIndex:
        """Postings, documents and vocabulary of ``title``, ``content`` or ``lua``."""
        found = self.store.manifest()
        terms, words = (self.store.read(f"{kind}.{n}", found) for n in ("terms", "words"))
        docs, newer = self._segments(kind, found)
        if len(found.tables[kind]) > 1:
            terms, words = live_postings(terms, docs, newer), words.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return SearchIndex(terms.select("term", "id"), self.documents(kind, found).select("id", "field_len", *META), words, tuple(found.state[f"{kind}.total"]))

    def searched(self, kind: str) -> tuple[SearchIndex, DataFrame]:
        """``index`` and ``documents``, from memory if the engine is warm."""
        if not self.warm:
            return self.index(kind), self.documents(kind)
        paths = [p for n in (kind, f"{kind}.terms", f"{kind}.words") for p in self.store.manifest().tables[n]]
        if kind not in self._kept or self._kept[kind][0] != paths:
            if kind in self._kept:
                _, old, docs = self._kept.pop(kind)
                for df in (old.postings, old.stats, old.words, docs):
                    df.unpersist()
            found, docs = self.index(kind), self.documents(kind)
            parts = [df.persist() for df in (by_term(found.postings), found.stats, by_term(found.words), docs)]
            self._kept[kind] = paths, SearchIndex(*parts[:3], found.totals), parts[3]
        return self._kept[kind][1:]

    def documents(self, kind: str, base: Manifest | None = None) -> DataFrame:
        """What is kept of every document of ``title``, ``content`` or ``lua``."""
        base = base or self.store.manifest()
        docs, newer = self._segments(kind, base)
        return live_documents(docs, newer) if len(base.tables[kind]) > 1 else docs.where(~F.col("removed")).drop("removed")

    def status(self, kind: str) -> str:
        """Missing, outdated, corrupt, replay-required or available."""
        if self.store.manifest().state.get(f"{kind}.key", self._key(kind)) != self._key(kind):
            return "outdated"
        return self.store.status(kind, self.sequence)

    def clear(self) -> None:
        """Forget the derived tables; a writer that began before fails to publish."""
        self.store.update(lambda base: ({}, {f"{k}.key": "" for k in ("title", "content", "lua")}))

    # searching

    def search(self, mode: str, query: str, namespace: int | None = None, limit: int = 20) -> DataFrame:
        """Q8: one of MODES; derived tables are brought up to date first."""
        a = self.analyzer
        if mode in ("title", "content", "lua"):
            self.refresh(mode)
            index, docs = self.searched(mode)
        if mode == "title":
            ranked = search.title_search(index, query, a, namespace, limit)
            return search.combined_search(ranked, search.linear_search(self.rows(), query, a, namespace, limit), limit)
        if mode == "content":
            return search.content_search(index, docs.select("id", "text"), query, a, namespace, limit)
        if mode == "lua":
            return search.lua_search(docs, query, a, limit, index=index)
        if mode == "data":
            codes = self.store.read("data")
            if codes is None or self.store.manifest().state.get("data.key") != self._key("data"):
                raise LookupError("no data codes are loaded under these rules")
            return search.data_code_search(codes, query, a, limit)
        if mode == "file":
            return search.linear_search(self.rows("files"), query, a, None, limit)
        raise ValueError(f"mode is one of {MODES}")

    def diagnostics(self) -> dict[str, int | str]:
        """Q9: counts of facts and states of derived tables."""
        live: Column = ~F.coalesce(F.col("deleted"), F.lit(False))
        model = F.lower("contentModel")
        counted = self.rows().agg(
            F.count_if(live).alias("pages"), F.count_if(~live).alias("tombstones"), F.count_if(live & F.col("content").isNotNull()).alias("bodies"),
            F.count_if(live & F.col("content").isNotNull() & (model == "scribunto")).alias("modules"),
        ).first()
        codes = self.store.read("data")
        return counted.asDict() | {
            "files": search.live(self.rows("files")).count(), "data codes": 0 if codes is None else codes.count(), "sequence": self.sequence,
        } | {f"{k} index": self.status(k) for k in ("title", "content", "lua")}
