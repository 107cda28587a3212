import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sparkloom.engine import Workspace
from sparkloom.operators import documents as D
from sparkloom.operators import predict as P
from sparkloom.schema import RAW
from sparkloom.sources import normalize as M
from sparkloom.sources.datasource import EnvelopeSource, write_envelopes
from sparkloom.sources.registry import Descriptor, Registry, builtin
from sparkloom.sources.throttle import AdaptiveRate, Backoff, TokenBucket

MASTER = b"m" * 32
NOW = dt.datetime(2026, 9, 26, 18, tzinfo=dt.timezone.utc)


def slack(i, user, text, thread=None, **more):
    ts = f"{1790000000 + i * 60}.000100"
    return {"ts": ts, "user": user, "text": text, "thread_ts": thread, "_stream_label": "ops", "_user_profile": {"real_name": {"u1": "Ann Lee", "u2": "Bob Ray"}[user], "email": {"u1": "ann@corp.io", "u2": "bob@corp.io"}[user]}} | more


SLACK = [slack(0, "u1", "We decided to ship the <#C1|ops> rebalancer by 2026-10-02."), slack(1, "u2", "when is the budget review", files=[{"id": "f1", "name": "plan.pdf", "mimetype": "application/pdf", "size": 5}]), slack(2, "u1", "later maybe"), slack(3, "u2", "still waiting on that"), slack(4, "u1", "x", subtype="channel_join")]
GMAIL = {"id": "g1", "threadId": "t1", "internalDate": "1790000000000", "snippet": "s", "labelIds": ["SENT"], "payload": {"headers": [{"name": "From", "value": '"Ann Lee" <ann@corp.io>'}, {"name": "Subject", "value": "Budget"}], "mimeType": "multipart/mixed", "parts": [{"mimeType": "multipart/alternative", "parts": [{"mimeType": "text/plain", "body": {"data": "SGVsbG8gYnVkZ2V0"}}]}, {"partId": "2", "filename": "a.csv", "mimeType": "text/csv", "body": {"size": 3, "attachmentId": "x"}}]}}


def envelopes(spark, provider, stream, payloads):
    rows = [(f"{provider}:{stream}:{i}", provider, stream, p if isinstance(p, str) else json.dumps(p), None, None) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, RAW)


def test_workspace(spark, tmp_path):
    w = Workspace(spark, f"file://{tmp_path}/ws", master=MASTER)
    raw = envelopes(spark, "slack", "c1", [*SLACK, "not json"]).unionByName(envelopes(spark, "gmail", "inbox", [GMAIL]))
    got = w.sync(raw, 1, now=NOW)
    assert (got["seen"], got["fresh"], got["quarantined"]) == (7, 7, 1)
    assert [got[k] for k in ("identities", "graph", "insights", "predictions")] == ["ok"] * 4
    again = w.sync(raw, 2, now=NOW)
    assert again["fresh"] == 0 and w.read("messages").count() == 5 and w.read("files").count() == 2
    people = {r["display_name"]: r for r in w.persons().collect()}
    assert people["Ann Lee"]["cross_source"] and people["Ann Lee"]["providers"] == ["gmail", "slack"]
    hits = w.search("rebalancer").collect()
    assert len(hits) == 1 and "rebalancer" in hits[0]["snippet"]
    assert w.search("in:c1 budget").count() == 1 and w.search("zzz").count() == 0
    page, total, facets = w.respond("budget", limit=1)
    assert page.count() == 1 and total.first().asDict() == {"total": w.search("budget").count(), "total_is_exact": True, "engine": "lexical"}
    assert facets.where("facet = 'provider'").agg(F.sum("n")).first()[0] == total.first()["total"]
    plan, rows = w.ask("how many messages are in slack", NOW)
    assert plan.execution == "facets" and rows.where("kind = 'message'").agg(F.sum("n")).first()[0] == 4
    kinds = {r["kind"] for r in w.predictions().collect()}
    assert kinds == {"deadline", "unanswered_question"}
    nodes, edges = w.ego(people["Ann Lee"]["person_id"], hops=1)
    assert {r["type"] for r in edges.collect()} >= {"HAS_IDENTITY", "SENT_BY"}
    assert nodes.count() > 3 and w.path(people["Ann Lee"]["person_id"], people["Bob Ray"]["person_id"]).first()["hops"] == 2
    assert w.passport().count() == 2 and w.timeline().count() > 0 and w.files().where("references = 1").count() == 2
    doc = hits[0]["_id"]
    assert w.document(doc).count() == 1 and w.siblings(doc).count() == 3 and w.summarize(doc).count() == 1
    assert w.importance(NOW).where("importance between 0 and 1").count() == 5
    assert {r["kind"] for r in w.suggest("OP").collect()} == {"title", "channel"} and w.conversations().count() == 2
    assert w.load_index() is None and w.save_index().first()["kept"] > 0 and w.load_index().count() > 0
    assert w.recent(people["Ann Lee"]["person_id"]).count() == 3 and w.runs().count() == 2 and w.suggestions().count() >= 0
    for _ in range(2):
        w.audit("sync", NOW, "x")
    assert w.read("audit").count() == 1
    w.review("a", "b", True) if w.read("links") is not None else None
    w.drop_derived()
    assert w.read("persons") is None and w.read("messages").count() == 5


def test_private_fields_are_sealed(spark, tmp_path):
    from sparkloom.config import EngineConfig

    folder = lambda n: f"file://{tmp_path}/{n}"
    video = {"id": "v2", "title": "W", "_caption_srt": "1\n00:00:01,500 --> 00:00:02,000\nhello there"}
    raw = envelopes(spark, "slack", "c1", [*SLACK, "not json"]).unionByName(envelopes(spark, "gmail", "inbox", [GMAIL])).unionByName(envelopes(spark, "youtube", "y", [video]))
    with pytest.raises(ValueError):
        Workspace(spark, folder("no"))
    plain = Workspace(spark, folder("plain"), EngineConfig(enable_encryption=False))
    closed = Workspace(spark, folder("closed"), master=MASTER)
    for w in (plain, closed):
        w.sync(raw, 1, rebuild=False)
        w.ingest.table("messages").merge(w.read("messages").where("provider = 'gmail'").withColumn("_ingested", F.lit(2).cast("bigint")))
    other = Workspace(spark, folder("closed"), master=b"x" * 32)
    for name, field in (("messages", "body_text"), ("messages", "extra"), ("transcripts", "text"), ("transcripts", "segments"), ("raw_artifacts", "payload"), ("quarantine", "payload")):
        rows = lambda t: sorted(map(str, t.collect()))
        a, b = plain.read(name), closed.read(name)
        assert a.schema.simpleString() == b.schema.simpleString() and rows(a) == rows(b), name
        assert rows(a) != rows(closed.ingest.table(name).stored()), name
        assert other.read(name).where(F.col(field).isNotNull()).count() == 0, name
    texts = "".join(str(r) for n in ("messages", "raw_artifacts", "quarantine", "transcripts") for r in closed.ingest.table(n).stored().collect())
    assert not any(x in texts for x in ("rebalancer", "hello there", "not json"))
    # an address stays only where it is a sender's reference
    assert "ann@corp.io" not in str(closed.ingest.table("messages").stored().where("provider = 'slack'").collect())
    # a table of a time without encryption opens as it is, and is sealed by the next write
    later = Workspace(spark, folder("plain"), master=MASTER)
    assert later.read("messages").where("body_text like '%rebalancer%'").count() == 1
    later.sync(envelopes(spark, "slack", "c2", [slack(9, "u1", "new")]), 3, rebuild=False)
    assert later.read("messages").where("body_text like '%rebalancer%' or body_text = 'new'").count() == 2
    assert "rebalancer" not in str(later.ingest.table("messages").stored().collect())


def test_stream_equals_batch(spark, tmp_path):
    spark.dataSource.register(EnvelopeSource)
    write_envelopes(f"{tmp_path}/in", "slack", "c1", SLACK[:2])
    w = Workspace(spark, f"file://{tmp_path}/ws", master=MASTER)
    read = lambda: spark.readStream.format("envelopes").option("path", f"{tmp_path}/in").load()
    w.ingest.stream(read(), f"{tmp_path}/ck").awaitTermination()
    assert w.read("messages").count() == 2
    write_envelopes(f"{tmp_path}/in", "slack", "c1", SLACK[2:])
    w.ingest.stream(read(), f"{tmp_path}/ck").awaitTermination()
    assert w.read("messages").count() == 4
    assert spark.read.format("envelopes").option("path", f"{tmp_path}/in").load().count() == 5


def test_envelopes_in_stretches(spark, tmp_path):
    """Whatever the stretch, each line is read once; a line without its end waits for it in a stream."""
    spark.dataSource.register(EnvelopeSource)
    lines = ["{}", '{"a": "ü€"}', "", '{"b": "' + "x" * 90 + '"}', '{"c": 1}\r', "last"]
    (tmp_path / "in").mkdir()
    path = tmp_path / "in" / "slack__c1.jsonl"
    path.write_bytes("\n".join(lines).encode())
    (tmp_path / "in" / "slack__none.jsonl").write_bytes(b"")
    want = [x.rstrip("\r") for x in lines]
    ids = set()
    for step in (1, 2, 7, 64, 1 << 20):
        rows = spark.read.format("envelopes").option("path", str(tmp_path / "in")).option("stretchBytes", step).load().collect()
        rows.sort(key=lambda r: int(r["raw_id"].rsplit(":", 1)[1]))
        assert [r["payload"] for r in rows] == want, step
        ids.add(tuple(r["raw_id"] for r in rows))
    assert len(ids) == 1
    seen = []

    def take():
        stream = spark.readStream.format("envelopes").option("path", str(tmp_path / "in")).option("stretchBytes", 50).load()
        stream.writeStream.foreachBatch(lambda df, n: seen.extend(r["payload"] for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        return sorted(seen)

    assert take() == sorted(want[:-1])
    with path.open("ab") as f:
        f.write(b" of all\nnext\n")
    assert take() == sorted([*want[:-1], "last of all", "next"])


@pytest.mark.parametrize(
    "provider, payload, table, want",
    [
        ("discord", {"id": "175928847299117063", "author": {"id": "9", "username": "neo"}, "content": "**hi**", "reactions": [{"name": "ok", "user_id": "1"}, {"name": "ok", "user_id": "2"}]}, "messages", {"ts": "2016-04-30T11:18:25Z", "body_text": "hi", "sender_ref": "discord:9"}),
        ("whatsapp", {"sender": "Ann", "body": "<attached: 0001-pic.jpg> look", "ts": "2026-01-01T00:00:00Z"}, "files", {"name": "pic.jpg", "mime": "image/jpeg"}),
        ("gdrive", {"id": "d1", "name": "x", "size": "7", "owners": [{"emailAddress": "a@b.c"}]}, "files", {"owner_ref": "gdrive:a@b.c", "size_bytes": 7}),
        ("onedrive", {"id": "o1", "name": "y", "@deleted": True}, "files", {"deleted": True}),
        ("dropbox", {"id": "b1", "name": "z.pdf", "path_display": "/a/b/z.pdf", ".tag": "file"}, "files", {"folder_path": ["a", "b"], "mime": "application/pdf"}),
        ("notion", {"id": "n1", "properties": {"N": {"type": "title", "title": [{"plain_text": "T"}]}}, "_blocks": [{"type": "heading_1", "heading_1": {"rich_text": [{"plain_text": "H"}]}}, {"type": "to_do", "to_do": {"rich_text": [{"plain_text": "do"}], "checked": True}}]}, "notes", {"title": "T", "body_text": "# H\n- [x] do", "block_count": 2}),
        ("evernote", {"guid": "e1", "title": "t", "content": "a\nb", "created": 0, "updated": 1000}, "notes", {"last_edited": "1970-01-01T00:00:01Z", "block_count": 2}),
        ("youtube", {"id": {"videoId": "v1"}, "snippet": {"title": "V", "duration": "PT1H2M3S"}}, "videos", {"provider_video_id": "v1", "duration_s": 3723}),
        ("youtube", {"id": "v2", "title": "W", "_caption_srt": "1\n00:00:01,500 --> 00:00:02,000\nhello\nthere\n\nbad"}, "transcripts", {"video_id": "v2", "text": "hello there", "seg_count": 1}),
    ],
)
def test_normalizers(spark, provider, payload, table, want):
    row = M.normalize(envelopes(spark, provider, "s", [payload]))[table].first().asDict(True)
    assert {k: row[k] for k in want} == want


def test_lineage(spark):
    out = M.normalize(envelopes(spark, "slack", "c1", SLACK[:2]))
    assert {r["lineage"]["source_artifact_id"] for t in ("messages", "files") for r in out[t].collect()} == {"slack:c1:0", "slack:c1:1"}


def test_unpack_export(tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("chat.txt", "x")
        z.writestr("__MACOSX/chat.txt", "x")
        z.writestr("run.exe", "x")
    assert [p.rsplit("/", 1)[1] for p in M.unpack_export(str(tmp_path / "a.zip"), str(tmp_path / "out"))] == ["chat.txt"]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../evil.txt", "x")
    with pytest.raises(ValueError):
        M.unpack_export(str(tmp_path / "b.zip"), str(tmp_path / "out"))


def test_folders_are_no_files(spark):
    raw = envelopes(spark, "dropbox", "s", [{"id": "b", "name": "d", ".tag": "folder"}]).unionByName(envelopes(spark, "onedrive", "s", [{"id": "o", "folder": {"childCount": 1}}]))
    assert M.normalize(raw)["files"].count() == 0


def test_whatsapp_lines(spark):
    lines = ["[15/01/2026, 10:32:11] Ann: hello", "more: of it", "15/01/2026, 10:33 - Ann created this group", "2/3/26, 9:05 - Bob: ok"]
    df = spark.createDataFrame([("c", i, x) for i, x in enumerate(lines)], "chat string, line_no int, line string")
    rows = [(r["sender"], r["body"], r["ts"]) for r in M.whatsapp_lines(df).orderBy("n").collect()]
    assert rows == [("Ann", "hello\nmore: of it", "2026-01-15T10:32:11Z"), ("", "Ann created this group", "2026-01-15T10:33:00Z"), ("Bob", "ok", "2026-03-02T09:05:00Z")]


def test_predicates(spark):
    df = spark.createDataFrame([("a", 1, ["x"], {"k": "v"}, [("n",)]), ("b", None, None, None, None)], "_id string, n int, tags array<string>, m map<string,string>, people array<struct<name:string>>")
    ids = lambda *f: [r["_id"] for r in D.matching(df, [D.Filter(*x) for x in f]).collect()]
    assert ids(("n", "ne", 5)) == ["a"] and ids(("n", "exists", False)) == ["b"] and ids(("tags", "in", ["x", "y"])) == ["a"] and ids(("tags", "contains", "x")) == ["a"]
    assert ids(("m.k", "eq", "v")) == ["a"] and ids(("people.name", "contains", "n")) == ["a"] and ids(("people.0.name", "eq", "n")) == ["a"] and ids(("n", "nin", [2])) == ["a"]
    assert [r["_id"] for r in D.find(df, D.Query(sort=(("n", True),))).collect()] == ["a", "b"]
    assert [r["_id"] for r in D.find(df, D.Query(sort=(("n", False),))).collect()] == ["b", "a"]
    with pytest.raises(ValueError):
        D.Filter("n", "near", 1)
    table = D.DocTable(df)
    assert table.get("a").count() == 1 and table.purge().df.count() == 0 and table.delete(df.where("_id = 'a'").select("_id")).df.count() == 1


def test_registry():
    assert len(builtin().ids()) == 10 and builtin().get("slack").cursor == "timestamp"
    with pytest.raises(ValueError):
        Registry().register(Descriptor("x", "1", "clock", (), {"read": ""}), lambda r: {})
    with pytest.raises(KeyError):
        builtin().get("nope")


def test_throttle():
    now = [0.0]
    b = TokenBucket(2, 1, lambda: now[0])
    assert b.take() == 0 and b.take() == 0.5
    now[0] = 0.5
    assert b.take() == 0
    r = AdaptiveRate(4, 5)
    r.slow_down()
    r.reward()
    assert abs(r.rate - 2.2) < 1e-9
    assert Backoff().delay(0, 7) == 7 and Backoff().again(0, 503) and not Backoff().again(0, 404) and not Backoff().again(5, 429)


def test_resurfacing_takes_all_anchors(spark):
    """The only anchors that are close stand after more than 1000 others."""
    rows = [(1, dt.datetime(2026, 1, 1), 100, [1.0, 0.0, 0.0]), (2, dt.datetime(2026, 1, 1), 100, [0.0, 1.0, 0.0]), (3, dt.datetime(2026, 9, 1), 100, [1.0, 0.0, 0.0])]
    old = spark.createDataFrame(rows, "_id bigint, ts timestamp, chars int, vec array<double>")
    recent = spark.createDataFrame([([0.0, 0.0, 1.0],)] * 3000 + [([1.0, 0.0, 0.0],), ([0.0, 0.6, 0.8],)], "vec array<double>").coalesce(1)
    now = F.to_timestamp(F.lit("2026-09-26 00:00:00"))
    assert {r["_id"]: round(r["similarity"], 6) for r in P.resurfacing(old, recent, now).collect()} == {1: 1.0, 2: 0.6}
    assert P.resurfacing(old, recent.limit(0), now).count() == 0


def test_filters_of_absent_fields(spark):
    from sparkloom.operators.documents import Filter, matching

    rows = spark.createDataFrame([(1, "a")], "_id int, provider string")
    assert matching(rows, [Filter("person_ids", "in", ["nobody"])]).count() == 0
    assert matching(rows, [Filter("person_ids", "exists", False)]).count() == 1


def test_excluded_words_go_from_every_leg(spark):
    from sparkloom.operators.search import without

    docs = spark.createDataFrame([("1", "Noise report", ""), ("2", "Report", "Ann")], "doc_id string, title string, sender_name string")
    scores = spark.createDataFrame([("1", 0.9), ("2", 0.5)], "doc_id string, score double")
    assert [r["doc_id"] for r in without(scores, docs, ["noise"]).collect()] == ["2"] and without(scores, docs, []).count() == 2


def test_projected_events_and_mentions(spark):
    from sparkloom.operators.graph import project

    m = spark.createDataFrame([("s:1", "s", "t", "s:u1", "c", "", ""), ("s:2", "s", "t", "s:gone", "c", "1", "")], "_id string, provider string, ts string, sender_ref string, conversation_id string, reply_to_id string, thread_root_id string")
    people = spark.createDataFrame([("per_1", "Ann", 1, ["i1"])], "person_id string, display_name string, message_count int, identity_ids array<string>")
    ids = spark.createDataFrame([("i1", "s", "s:u1")], "_id string, provider string, ref string")
    notes = spark.createDataFrame([("n:1", "note", "s:u1")], "_id string, title string, author_ref string")
    said = spark.createDataFrame([("s:2", "per_1")], "_id string, resolved_person_id string")
    due = spark.createDataFrame([("s:2", "2026-01-01T00:00:00Z", "hard", "due")], "_id string, due string, hardness string, cue string")
    nodes, edges = project({"messages": m, "persons": people, "identities": ids, "notes": notes, "mentions": said, "deadlines": due})
    got = {(r["src"], r["type"], r["dst"]) for r in edges.collect()}
    assert {("s:2", "SENT_BY", "per_unknown_s_gone"), ("s:2", "MENTIONS", "per_1"), ("s:2", "REPLY_TO", "s:1"), ("n:1", "AUTHORED", "per_1"), ("per_1", "PARTICIPATED_IN", "s:c")} <= got
    assert sum(t == "PREDICTED_DUE" for _, t, _ in got) == 1 and nodes.where("label = 'Event'").count() == 1
