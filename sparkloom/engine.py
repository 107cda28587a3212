"""The workspace facade: ingest, derive, search, ask, browse. Results are DataFrames."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EngineConfig
from .functions.dates import extract_deadlines
from .functions.privacy import KeyRing, identity_token, normalize_email, normalize_name, normalize_phone
from .functions.text import mentions, snippet
from .functions.vectors import embed_text, embed_udf
from .operators import documents as D
from .operators import graph as G
from .operators import identity as I
from .operators import insights as N
from .operators import predict as P
from .operators import search as S
from .operators.summarize import summarizer
from .plans.compiler import QueryPlan, SearchRequest, compile_question, execute
from .plans.grammar import parse
from .sources.registry import builtin
from .streaming.ingest import Ingest, conversations, identities

DERIVED = ("identities", "persons", "suggestions", "nodes", "edges", "insights", "links", "predictions", "postings")


class Workspace:
    """Tables below a folder. ``master`` is the key that private fields are sealed under; only a configuration
    without encryption does without it."""

    def __init__(self, spark: SparkSession, folder: str, config: EngineConfig | None = None, pepper: bytes | None = None, self_refs: tuple[str, ...] = (), master: bytes | None = None, name: str = "workspace"):
        self.spark, self.config, self.self_refs = spark, config or EngineConfig(), list(self_refs)
        if self.config.enable_encryption and not master:
            raise ValueError("encryption is on: give a master key, or EngineConfig(enable_encryption=False)")
        ring = KeyRing(master, name) if self.config.enable_encryption else None
        self.pepper = pepper or (ring.pepper() if ring else b"workspace")
        self.ingest = Ingest(spark, folder, ring)
        self.sources = builtin()

    def read(self, name: str) -> DataFrame | None:
        return self.ingest.table(name).read()

    # --- ingest and derive ---

    def sync(self, raw: DataFrame, stamp: int, rebuild: bool = True, now: dt.datetime | None = None) -> dict:
        counts = self.ingest.run(raw, stamp)
        return counts | (self.rebuild(now) if rebuild and counts["fresh"] else {})

    def rebuild(self, now: dt.datetime | None = None) -> dict[str, str]:
        """Every derived table anew from the documents; a stage that fails is reported and the others run."""
        now = now or dt.datetime.now(dt.timezone.utc)
        status = {}
        for name, stage in (("identities", self.resolve), ("graph", self.project), ("insights", lambda: self.detect(now)), ("predictions", lambda: self.predict(now))):
            try:
                stage()
                status[name] = "ok"
            except Exception as e:  # noqa: BLE001  stages are isolated from each other
                status[name] = f"failed: {e}"[:500]
        return status

    def resolve(self) -> None:
        messages = self.read("messages")
        if messages is None:
            return
        ids = identities(messages)
        ids = ids.withColumn("email_token", identity_token(self.pepper, "email", normalize_email("email"))).withColumn("phone_token", identity_token(self.pepper, "phone", normalize_phone("phone"))).withColumn("name_token", identity_token(self.pepper, "name", normalize_name("display_name")))
        self.ingest.table("identities").replace(ids)
        ids = self.read("identities")
        near = I.cooccurrence_pairs(messages.withColumn("ts", F.to_timestamp("ts")))
        pairs = I.candidate_pairs(I.block_keys(ids)).unionByName(near).distinct()
        scores = I.score_pairs(pairs, ids, I.shared_conversations(pairs, messages, ids), self.config.merge_threshold, self.config.suggest_threshold)
        self.ingest.table("persons").replace(I.persons(ids, I.clusters(ids, scores)))
        self.ingest.table("suggestions").replace(I.suggestions(scores))

    def tables(self) -> dict[str, DataFrame]:
        names = ("persons", "identities", "messages", "files", "notes", "videos", "transcripts")
        return {n: t for n in names if (t := self.read(n)) is not None}

    def project(self) -> None:
        have = self.tables()
        if "messages" in have:
            have["deadlines"] = self.deadlines()
            if "persons" in have:
                have["mentions"] = mentions(have["messages"], have["persons"].select(F.col("display_name").alias("name"), "person_id").where("name <> ''"))
        if have:
            nodes, edges = G.project(have)
            self.ingest.table("nodes").replace(nodes)
            self.ingest.table("edges").replace(edges)

    def deadlines(self) -> DataFrame:
        """_id, due, hardness, confidence, cue of the deadlines in messages."""
        found = self.read("messages").select("_id", F.explode(extract_deadlines(F.col("body_text"), F.col("ts"))).alias("d"))
        return found.select("_id", "d.due", "d.hardness", "d.confidence", "d.cue")

    def person_of_ref(self) -> DataFrame:
        member = self.read("persons").select("person_id", F.explode("identity_ids").alias("_id"))
        return member.join(self.read("identities").select("_id", "ref"), "_id").select("ref", "person_id")

    def detect(self, now: dt.datetime) -> None:
        messages, files = self.read("messages"), self.read("files")
        if messages is None:
            return
        owner = self.person_of_ref()
        docs = messages.join(owner.withColumnRenamed("ref", "sender_ref"), "sender_ref").withColumn("ts", F.to_timestamp("ts"))
        pairs = N.interactions(docs, ref="person_id")
        files = files if files is not None else messages.select("_id", F.lit("").alias("name"), F.lit("").alias("owner_ref"), F.lit("").alias("provider_file_id")).limit(0)
        refs = N.file_references(messages.select(F.explode("attachments").alias("a")).select("a.provider_file_id"), "provider_file_id")
        found = N.run_all(pairs, messages, self.read("persons"), files, refs, owner, F.lit(now).cast("timestamp"))
        self.ingest.table("insights").replace(found)
        nodes = self.read("nodes")
        if nodes is not None:
            links = G.advisory_edges(self.read("insights"), nodes)
            old = self.read("links")
            if old is not None:  # what was accepted stays, whatever is rebuilt
                kept = old.where("state = 'accepted'")
                links = kept.unionByName(links.join(kept.select("src", "dst"), ["src", "dst"], "left_anti").select(*kept.columns))
            self.ingest.table("links").replace(links)

    def predict(self, now: dt.datetime) -> None:
        messages = self.read("messages")
        if messages is None:
            return
        at = F.lit(now).cast("timestamp")
        due = self.deadlines().withColumn("due", F.to_timestamp("due"))
        a = P.deadline_predictions(due, at).select(F.lit("deadline").alias("kind"), "_id", "score", "days")
        b = P.follow_ups(messages.withColumn("ts", F.to_timestamp("ts")), at).select(F.lit("unanswered_question").alias("kind"), "_id", "score", "days")
        self.ingest.table("predictions").replace(a.unionByName(b))

    # --- queries ---

    def search(self, question: str, limit: int | None = None, offset: int = 0, now: dt.datetime | None = None) -> DataFrame:
        """Hits with score, title and snippet: BM25, fused with vectors where the configuration has them on."""
        scores, indexed, terms = self.scores(question, now)
        return self.hits(S.top(scores, limit or self.config.result_limit, offset), indexed, terms)

    def respond(self, question: str, limit: int | None = None, offset: int = 0, now: dt.datetime | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(hits; total, total_is_exact, engine; facets): the last two over all that is found, up to the window of S.page."""
        limit = limit or self.config.result_limit
        scores, indexed, terms = self.scores(question, now)
        page, total = S.page(scores, limit, offset)
        found = S.top(scores, S.window(limit)).select(F.col("doc_id").alias("_id"))
        engine = F.lit("hybrid" if self.config.enable_vector else "lexical").alias("engine")
        return self.hits(page, indexed, terms), total.select("*", engine), S.result_facets(indexed.join(found, "_id", "left_semi"))

    def hits(self, best: DataFrame, indexed: DataFrame, terms: list[str]) -> DataFrame:
        shown = ["_id", "score", "kind", "provider", "title", "ts", snippet("body", " ".join(terms)).alias("snippet")]
        return best.withColumnRenamed("doc_id", "_id").join(indexed, "_id").select(*shown).orderBy(F.desc("score"), "_id")

    def scores(self, question: str, now: dt.datetime | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
        """(doc_id and score of all that a question finds, the documents with their bodies, the terms asked for)."""
        parsed, plan = parse(question, now), compile_question(question, self.config.result_limit, now)
        docs = self.ingest.documents()
        shown = self.shown(docs)
        allowed = D.matching(shown, plan.request.filters()).select(F.col("_id").alias("doc_id"))
        body = F.concat_ws("\n", *[F.col(c) for c in ("title", "name", "body_text", "text", "description") if c in docs.columns])
        # fields that matter more are said more often in a document's vector
        said = F.concat_ws("\n", *["title"] * 3, *["sender_name"] * 2, "channel", "body")
        indexed = shown.join(docs.select("_id", body.alias("body")), "_id")
        index = S.build_index(indexed, "_id", {n: F.col(n) for n in ("title", "sender_name", "channel", "provider", "body")})
        hits = S.bm25(index, parsed.retrieval_terms(), allowed, parsed.phrases, parsed.exclude)
        if self.config.enable_vector:
            vectors = indexed.join(allowed.withColumnRenamed("doc_id", "_id"), "_id", "left_semi").select("_id", embed_udf(self.config.embed_dim)(said).alias("v"))
            asked = self.spark.createDataFrame([(embed_text(parsed.text, self.config.embed_dim),)], "vec array<double>")
            near = S.without(S.gate(S.similar(vectors, asked, "_id", "v")), index.documents, parsed.exclude)
            hits = S.fuse(hits, near, self.config.rrf_k)
        return hits, indexed, parsed.retrieval_terms()

    def shown(self, docs: DataFrame) -> DataFrame:
        """The content-free projection, with the persons behind each document's sender."""
        shown = S.search_documents(docs)
        if self.read("persons") is None:
            return shown.withColumn("person_ids", F.array().cast("array<string>"))
        return I.stamp_persons(shown, self.person_of_ref(), ["sender_ref"])

    def facets(self, hits: DataFrame) -> DataFrame:
        """facet, value, n over the hits of a search."""
        return S.result_facets(self.shown(self.ingest.documents()).join(hits.select("_id"), "_id", "left_semi"))

    def index_version(self) -> dict[str, list[int]]:
        """What a saved index is held against: the versions of the content tables."""
        return {n: v[-1:] for n in ("messages", "files", "notes", "videos", "transcripts") if (v := self.ingest.table(n).versions())}

    def save_index(self) -> DataFrame:
        """Write the postings of terms that enough documents hold; returns how many terms are kept and dropped."""
        docs = self.ingest.documents()
        body = F.concat_ws("\n", *[F.col(c) for c in ("title", "name", "body_text", "text", "description") if c in docs.columns])
        index = S.build_index(S.search_documents(docs).join(docs.select("_id", body.alias("body")), "_id"), "_id", {n: F.col(n) for n in ("title", "sender_name", "channel", "provider", "body")})
        kept, counts = S.k_anonymous(index, self.config.index_k_anonymity)
        self.ingest.table("postings").replace(kept.withColumn("index_version", F.lit(str(self.index_version()))))
        return counts

    def load_index(self) -> DataFrame | None:
        """The saved postings, or None where there are none or the documents have changed since."""
        have = self.read("postings")
        if have is None or have.where(F.col("index_version") == str(self.index_version())).isEmpty():
            return None
        return have.drop("index_version")

    def recent(self, person_id: str, limit: int = 10) -> DataFrame:
        """A person's newest messages."""
        own = self.person_of_ref().where(F.col("person_id") == person_id).select(F.col("ref").alias("sender_ref"))
        return self.read("messages").join(own, "sender_ref", "left_semi").orderBy(F.desc("ts"), "_id").limit(limit)

    def suggestions(self, limit: int = 50) -> DataFrame:
        return I.suggestions(self.read("suggestions")).limit(limit)

    def runs(self, limit: int = 20) -> DataFrame:
        return self.read("ingest_runs").orderBy(F.desc("stamp")).limit(limit)

    def audit(self, action: str, at: dt.datetime, detail: str = "") -> None:
        """Append to the audit log; an entry's id is its content, so that a repeated one is one."""
        row = self.spark.createDataFrame([(action, at, detail)], "action string, at timestamp, detail string")
        row = row.withColumn("_id", F.sha2(F.concat_ws("|", "action", F.col("at").cast("string"), "detail"), 256)).withColumn("_ingested", F.unix_micros("at"))
        self.ingest.table("audit").merge(row)

    def ask(self, question: str, now: dt.datetime | None = None) -> tuple[QueryPlan, DataFrame]:
        plan = compile_question(question, self.config.result_limit, now)
        shown = self.shown(self.ingest.documents())
        return plan, execute(plan, shown, lambda r: self.search(r.q, r.limit, now=now))

    def suggest(self, needle: str) -> DataFrame:
        shown = S.search_documents(self.ingest.documents())
        return S.suggest(shown.select("title", "sender_name", "channel"), needle)

    def timeline(self, request: SearchRequest | None = None, limit: int = 50) -> DataFrame:
        shown = self.shown(self.ingest.documents())
        return D.timeline([D.matching(shown, (request or SearchRequest()).filters())], limit=limit)

    def passport(self) -> DataFrame:
        docs = S.search_documents(self.ingest.documents())
        return D.passport(docs, "provider", "kind", ["message", "email", "file", "note", "video", "transcript"])

    def files(self, limit: int = 50) -> DataFrame:
        refs = N.file_references(self.read("messages").select(F.explode("attachments").alias("a")).select("a.provider_file_id"), "provider_file_id")
        return self.read("files").join(refs, "provider_file_id", "left").withColumn("references", F.coalesce("references", F.lit(0))).orderBy(F.desc("modified_ts"), "_id").limit(limit)

    def document(self, doc_id: str) -> DataFrame:
        return D.get(self.ingest.documents(), doc_id)

    def siblings(self, doc_id: str) -> DataFrame:
        return D.siblings(self.read("messages"), "conversation_id", "ts", "_id").where(F.col("_id") == doc_id)

    def summarize(self, doc_id: str, most: int = 5) -> DataFrame:
        docs = self.ingest.documents()
        body = F.coalesce(*[F.col(c) for c in ("body_text", "text", "description") if c in docs.columns])
        return summarizer(self.config.ai_mode)(D.get(docs, doc_id).withColumn("_body", body), "_id", "_body", most)

    def importance(self, now: dt.datetime) -> DataFrame:
        messages = self.read("messages").withColumn("ts", F.to_timestamp("ts"))
        return P.importance(messages, F.lit(now).cast("timestamp"), self.self_refs, attachments=F.size("attachments") > 0, inbound=F.col("direction") == "inbound")

    def conversations(self) -> DataFrame:
        return conversations(self.read("messages"))

    def ego(self, node_id: str, **options) -> tuple[DataFrame, DataFrame]:
        return G.ego(self.read("nodes"), self.read("edges"), node_id, **options)

    def path(self, src: str, dst: str, max_hops: int = 4) -> DataFrame:
        return G.shortest_paths(self.read("edges"), src, dst, max_hops)

    def persons(self, cross_source: bool = False, limit: int = 50) -> DataFrame:
        p = self.read("persons")
        return (p.where("cross_source") if cross_source else p).orderBy(F.desc("message_count"), "person_id").limit(limit)

    def insights(self, detector: str | None = None, min_confidence: float = 0.0, limit: int = 50) -> DataFrame:
        rows = self.read("insights").where(F.col("confidence") >= min_confidence)
        return (rows.where(F.col("detector") == detector) if detector else rows).orderBy(F.desc("confidence"), "detector", "title").limit(limit)

    def review(self, src: str, dst: str, accept: bool) -> None:
        self.ingest.table("links").replace(G.review(self.read("links"), src, dst, accept))

    def predictions(self, kind: str | None = None, limit: int = 50) -> DataFrame:
        rows = self.read("predictions")
        return (rows.where(F.col("kind") == kind) if kind else rows).orderBy(F.desc("score"), "kind", "_id").limit(limit)

    def drop_derived(self) -> None:
        for name in DERIVED:
            self.ingest.table(name).drop()

    def info(self) -> dict:
        return {"config": self.config, "sources": self.sources.ids(), "tables": [n for n in (*self.tables(), "insights", "predictions") if self.read(n) is not None]}
