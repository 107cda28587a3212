"""Provider payloads (JSON strings in a bronze table) to canonical rows, as column expressions.

Each normalizer takes raw rows (raw_id, provider, stream, payload, ...) and gives a table by kind. They
read nothing but their input, so a replay of the bronze table gives the same silver rows.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import iso
from ..functions.text import clean_text, content_hash

_FILE = "id string, name string, title string, filename string, mimetype string, content_type string, size bigint, permalink string, url_private string, url string"
SLACK = f"ts string, user string, bot_id string, text string, subtype string, thread_ts string, reply_count int, files array<struct<{', '.join(x.replace(' ', ':', 1) for x in _FILE.split(', '))}>>, reactions array<struct<name:string,count:bigint,users:array<string>>>, _user_profile struct<real_name:string,name:string,email:string,phone:string>, _is_self boolean, _channel_type string, _stream_label string"
DISCORD = "id string, type int, content string, author struct<id:string,username:string,global_name:string,bot:boolean>, attachments array<struct<id:string,filename:string,content_type:string,size:bigint,url:string>>, reactions array<struct<name:string,user_id:string>>, message_reference struct<message_id:string>, _guild_name string, _stream_label string"
GDRIVE = "id string, name string, mimeType string, size string, modifiedTime string, createdTime string, webViewLink string, parents array<string>, md5Checksum string, shared boolean, owners array<struct<emailAddress:string,displayName:string>>"
ONEDRIVE = "id string, name string, size bigint, lastModifiedDateTime string, createdDateTime string, eTag string, folder struct<childCount:int>, file struct<mimeType:string>, parentReference struct<id:string>, `@deleted` boolean, `@removed` struct<reason:string>"
DROPBOX = "id string, name string, size bigint, server_modified string, path_display string, rev string, `.tag` string"
EVERNOTE = "guid string, key string, title string, content string, created bigint, updated bigint, notebookGuid string, tagResources struct<tag:array<struct<name:string>>>"
YOUTUBE = "id string, title string, snippet struct<title:string,description:string,channelId:string,channelTitle:string,publishedAt:string,duration:string,tags:array<string>>, _playlist_label string, _caption_srt string, _caption_lang string"
GMAIL = "id string, threadId string, internalDate string, snippet string, labelIds array<string>"
WHATSAPP = "sender string, body string, ts string, index bigint, _chat_label string"
# MIME types by extension, and what each provider calls a conversation.
MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "pdf": "application/pdf", "opus": "audio/ogg", "m4a": "audio/mp4", "mp4": "video/mp4", "3gp": "video/3gpp", "webp": "image/webp", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}
CONVERSATION_KIND = {"slack": "channel", "discord": "channel", "gmail": "email_thread", "whatsapp": "chat", "notion": "workspace"}


def parsed(raw: DataFrame, provider: str, schema: str) -> DataFrame:
    """Rows of one provider with the payload parsed; payloads that do not parse are left out (see quarantine)."""
    good = (F.col("provider") == provider) & F.try_parse_json("payload").isNotNull() & F.ltrim("payload").startswith("{")
    return raw.where(good).withColumn("p", F.from_json("payload", schema))


def quarantine(raw: DataFrame) -> DataFrame:
    """Rows whose payload is no JSON object: kept for inspection, never lost silently."""
    return raw.where(F.col("payload").isNull() | F.try_parse_json("payload").isNull() | ~F.ltrim("payload").startswith("{"))


def _map(**pairs: Column) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v.cast("string"))])


def _lineage(rows: DataFrame) -> Column:
    """Which envelope a record came from; files attached to a message carry the message's."""
    if "lineage" in rows.columns:
        return F.col("lineage")
    return F.struct(F.col("raw_id").alias("source_artifact_id"), "provider", "stream")


def _id(key: Column) -> Column:
    return F.concat_ws(":", "provider", key)


def _mime_of(name: Column) -> Column:
    ext = F.lower(F.substring_index(name, ".", -1))
    table = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(table[ext], F.lit("application/octet-stream"))


def _message(rows: DataFrame, kind: str, msg_id, conversation, sender_ref, sender_name, ts, body, flavour, **more) -> DataFrame:
    text = clean_text(body, flavour)
    none = F.lit("")
    cols = {
        "_id": _id(msg_id), "kind": F.lit(kind), "provider": F.col("provider"), "provider_msg_id": msg_id, "conversation_id": conversation, "thread_root_id": more.get("root", none), "reply_to_id": F.coalesce(more.get("reply", none), none),
        "sender_ref": sender_ref, "sender_name": F.coalesce(sender_name, none), "ts": ts, "body_text": text, "body_hash": content_hash(text), "lang": F.lit("en"), "direction": more.get("direction", F.lit("unknown")),
        "attachments": more.get("attachments", F.array()).cast("array<struct<provider_file_id:string,name:string,mime:string,size_bytes:bigint>>"),
        "reactions": more.get("reactions", F.array()).cast("array<struct<emoji:string,count:bigint,users:array<string>>>"), "extra": more.get("extra", F.create_map()).cast("map<string,string>"), "lineage": _lineage(rows),
    }
    return rows.select(*[c.alias(n) for n, c in cols.items()])


def _file(rows: DataFrame, file_id, name, mime, size, modified, **more) -> DataFrame:
    none = F.lit("")
    cols = {
        "_id": _id(file_id), "kind": F.lit("file"), "provider": F.col("provider"), "provider_file_id": file_id, "name": name, "mime": F.coalesce(mime, F.lit("application/octet-stream")), "size_bytes": F.coalesce(size.cast("bigint"), F.lit(0)),
        "modified_ts": modified, "created_ts": more.get("created", modified), "path": more.get("path", none), "folder_path": more.get("folders", F.array()).cast("array<string>"), "owner_ref": more.get("owner", none),
        "shared_with": F.array().cast("array<string>"), "checksum": more.get("checksum", none), "deleted": F.coalesce(more.get("deleted", F.lit(False)), F.lit(False)), "extra": more.get("extra", F.create_map()).cast("map<string,string>"), "lineage": _lineage(rows),
    }
    return rows.select(*[c.alias(n) for n, c in cols.items()])


def attached_files(messages: DataFrame) -> DataFrame:
    """File rows of the attachments of messages; the sender owns them."""
    rows = messages.select("provider", "conversation_id", "sender_ref", "ts", "lineage", F.explode("attachments").alias("a"))
    return _file(rows, F.col("a.provider_file_id"), F.col("a.name"), F.col("a.mime"), F.col("a.size_bytes"), F.col("ts"), owner=F.col("sender_ref"), extra=_map(conversation_id=F.col("conversation_id"), sent_by=F.col("sender_ref")))


def slack(raw: DataFrame) -> dict[str, DataFrame]:
    p = lambda c: F.col(f"p.{c}")
    rows = parsed(raw, "slack", SLACK).where(~F.coalesce(p("subtype"), F.lit("")).isin("channel_join", "channel_leave", "bot_message"))
    user = F.coalesce(p("user"), p("bot_id"), F.lit("unknown"))
    files = F.transform(F.coalesce(p("files"), F.array()), lambda f: F.struct(f["id"], F.coalesce(f["name"], f["title"], F.lit("file")), F.coalesce(f["mimetype"], F.lit("application/octet-stream")), F.coalesce(f["size"], F.lit(0))))
    reactions = F.transform(F.coalesce(p("reactions"), F.array()), lambda r: F.struct(r["name"], F.coalesce(r["count"], F.lit(0)), F.slice(F.coalesce(r["users"], F.array()), 1, 20)))
    threaded = p("thread_ts").isNotNull() & (p("thread_ts") != p("ts"))
    out = _message(
        rows, "message", p("ts"), F.col("stream"), F.concat(F.lit("slack:"), user), F.coalesce(p("_user_profile.real_name"), p("_user_profile.name"), user), iso(F.timestamp_seconds(p("ts").cast("double"))), p("text"), "slack",
        root=F.when(threaded, p("thread_ts")).otherwise(""), reply=F.when(threaded, p("thread_ts")), direction=F.when(p("_is_self"), "outbound").otherwise("inbound"), attachments=files, reactions=reactions,
        extra=_map(channel_type=p("_channel_type"), channel_label=p("_stream_label"), subtype=p("subtype"), sender_email=p("_user_profile.email"), sender_phone=p("_user_profile.phone")),
    )
    return {"messages": out, "files": attached_files(out)}


def discord(raw: DataFrame) -> dict[str, DataFrame]:
    p = lambda c: F.col(f"p.{c}")
    rows = parsed(raw, "discord", DISCORD).where(~F.coalesce(p("author.bot"), F.lit(False)) & (F.coalesce(p("type"), F.lit(0)) == 0))
    ts = iso(F.timestamp_millis(F.shiftright(p("id").cast("bigint"), 22) + F.lit(1420070400000)))
    files = F.transform(F.coalesce(p("attachments"), F.array()), lambda f: F.struct(f["id"], F.coalesce(f["filename"], F.lit("attachment")), F.coalesce(f["content_type"], F.lit("application/octet-stream")), F.coalesce(f["size"], F.lit(0))))
    given = F.coalesce(p("reactions"), F.array())
    reactions = F.transform(F.array_distinct(F.transform(given, lambda r: r["name"])), lambda e: F.struct(e, F.size(F.filter(given, lambda r: r["name"] == e)).cast("bigint"), F.transform(F.filter(given, lambda r: r["name"] == e), lambda r: r["user_id"])))
    out = _message(
        rows, "message", p("id"), F.col("stream"), F.concat(F.lit("discord:"), p("author.id")), F.coalesce(p("author.global_name"), p("author.username")), ts, p("content"), "markdown",
        reply=p("message_reference.message_id"), direction=F.lit("inbound"), attachments=files, reactions=reactions, extra=_map(guild=p("_guild_name"), channel_label=p("_stream_label")),
    )
    return {"messages": out, "files": attached_files(out)}


def whatsapp(raw: DataFrame) -> dict[str, DataFrame]:
    p = lambda c: F.col(f"p.{c}")
    rows = parsed(raw, "whatsapp", WHATSAPP)
    sender = F.coalesce(p("sender"), F.lit(""))
    names = F.transform(F.regexp_extract_all(F.coalesce(p("body"), F.lit("")), F.lit(r"<attached:\s*([^>]+)>"), F.lit(1)), lambda x: F.btrim(x))
    shown = lambda n: F.when(n.contains("-"), F.regexp_replace(n, "^[^-]*-", "")).otherwise(n)
    files = F.transform(names, lambda n: F.struct(F.concat_ws(":", "raw_id", n), shown(n), _mime_of(n), F.lit(0).cast("bigint")))
    body = F.regexp_replace(p("body"), r"<attached:\s*[^>]+>", "")
    media = F.lower(F.btrim(p("body"))).rlike(r"^(?:image|video|audio|document|sticker)\s+(?:omitted|not included)")
    out = _message(
        rows, "message", F.col("raw_id"), F.col("stream"), F.concat(F.lit("whatsapp:"), F.when(sender == "", "system").otherwise(sender)), sender, p("ts"), body, "whatsapp",
        attachments=files, extra=_map(chat_label=p("_chat_label"), index=p("index"), is_system=sender == "", media_only=media, phone_hint=F.get(F.split(sender, " "), F.lit(0))),
    )
    return {"messages": out, "files": attached_files(out)}


_HEADER = r"^\[?(\d{1,4}[/.\-]\d{1,2}[/.\-]\d{1,4})[,.]?\s+(\d{1,2}:\d{2}(?::\d{2})?)\s*(?:\]?\s*[-–—]|\])\s*(.*)$"


def whatsapp_lines(lines: DataFrame) -> DataFrame:
    """Envelopes of chat exports: lines(chat, line_no, line) with continuation lines joined to their message.

    A chat is one file and its lines are grouped within it; the first date order that fits is taken, day first.
    """
    head = F.regexp_extract(F.regexp_replace("line", "[‎‏؜]", ""), _HEADER, 0) != ""
    part = lambda i: F.regexp_extract(F.regexp_replace("line", "[‎‏؜]", ""), _HEADER, i)
    w = Window.partitionBy("chat").orderBy("line_no")
    rows = lines.withColumn("head", head).withColumn("n", F.sum(F.col("head").cast("int")).over(w)).where("n > 0")
    rows = rows.select("chat", "n", "line_no", F.when(F.col("head"), part(1)).alias("d"), F.when(F.col("head"), part(2)).alias("t"), F.when(F.col("head"), part(3)).otherwise(F.col("line")).alias("text"))
    msg = rows.groupBy("chat", "n").agg(F.min_by("d", "line_no").alias("d"), F.min_by("t", "line_no").alias("t"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    at = F.coalesce(*[F.try_to_timestamp(F.concat_ws(" ", "d", F.when(F.length("t") - F.length(F.replace("t", F.lit(":"), F.lit(""))) == 1, F.concat("t", F.lit(":00"))).otherwise(F.col("t"))), F.lit(f"{f} H:mm:ss")) for f in ("d/M/yyyy", "d/M/yy", "yyyy-M-d", "d-M-yyyy", "M/d/yyyy", "M/d/yy")])
    named = F.col("text").rlike(r"^[^:\n]{1,60}:\s")
    return msg.select("chat", "n", F.when(named, F.substring_index("text", ":", 1)).otherwise("").alias("sender"), F.when(named, F.regexp_replace("text", r"^[^:\n]{1,60}:\s*", "")).otherwise(F.col("text")).alias("body"), iso(at).alias("ts"))


MAIL = "struct<body:string,attachments:array<struct<provider_file_id:string,name:string,mime:string,size_bytes:bigint>>,headers:map<string,string>>"


def mime_tree(payloads: pd.Series) -> pd.DataFrame:
    """Body, attachments and headers of mail payloads; a MIME tree is of any depth, so it is walked in Python."""

    def leaves(part):
        return [x for c in part.get("parts") or [] for x in leaves(c)] if part.get("parts") else [part]

    def text(data):
        return base64.urlsafe_b64decode(data + "=" * (-len(data) % 4)).decode("utf-8", "replace")

    rows = []
    for s in payloads:
        mail = json.loads(s) if s else {}
        root = mail.get("payload") or {}
        found, files = {}, []
        for part in leaves(root):
            kind, body = part.get("mimeType", ""), part.get("body") or {}
            if part.get("filename"):
                files.append({"provider_file_id": f"{mail.get('id')}:{part.get('partId')}", "name": part["filename"], "mime": kind, "size_bytes": body.get("size") or 0})
            elif body.get("data") and kind in ("text/plain", "text/html"):
                found.setdefault(kind, text(body["data"]))
        rows.append({"body": found.get("text/plain") or found.get("text/html") or "", "attachments": files, "headers": {h.get("name", "").lower(): h.get("value", "") for h in root.get("headers") or []}})
    return pd.DataFrame(rows, columns=["body", "attachments", "headers"])


def gmail(raw: DataFrame) -> dict[str, DataFrame]:
    p = lambda c: F.col(f"p.{c}")
    rows = parsed(raw, "gmail", GMAIL).withColumn("m", F.pandas_udf(mime_tree, MAIL)("payload"))
    header = lambda n: F.coalesce(F.col("m.headers")[n], F.lit(""))
    sender = header("from")
    address = F.btrim(F.when(sender.contains("<"), F.regexp_extract(sender, "<([^>]+)>", 1)).otherwise(sender))
    name = F.btrim(F.btrim(F.substring_index(sender, "<", 1)), F.lit('"'))
    out = _message(
        rows, "email", p("id"), F.coalesce(p("threadId"), p("id")), F.concat(F.lit("gmail:"), address), name, iso(F.timestamp_millis(p("internalDate").cast("bigint"))), F.col("m.body"), "plain",
        reply=header("in-reply-to"), direction=F.when(F.array_contains(F.coalesce(p("labelIds"), F.array().cast("array<string>")), "SENT"), "outbound").otherwise("inbound"), attachments=F.col("m.attachments"),
        extra=_map(subject=header("subject"), to=header("to"), cc=header("cc"), message_id_header=header("message-id"), snippet=p("snippet"), sender_email=address, labels=F.array_join(p("labelIds"), ",")),
    )
    return {"messages": out, "files": attached_files(out)}


def gdrive(raw: DataFrame) -> dict[str, DataFrame]:
    p = lambda c: F.col(f"p.{c}")
    owner = F.coalesce(F.get(p("owners"), F.lit(0))["emailAddress"], F.lit(""))
    return {"files": _file(parsed(raw, "gdrive", GDRIVE), p("id"), F.coalesce(p("name"), F.lit("")), p("mimeType"), p("size"), p("modifiedTime"), created=p("createdTime"), path=F.coalesce(p("webViewLink"), F.lit("")), folders=F.slice(F.coalesce(p("parents"), F.array()), 1, 1), owner=F.concat(F.lit("gdrive:"), F.when(owner == "", "unknown").otherwise(owner)), checksum=F.coalesce(F.concat(F.lit("md5:"), p("md5Checksum")), F.lit("")), extra=_map(shared=p("shared"), owner_email=owner))}


def onedrive(raw: DataFrame) -> dict[str, DataFrame]:
    p = lambda c: F.col("p").getField(c)
    rows = parsed(raw, "onedrive", ONEDRIVE).where(p("folder").isNull())
    return {"files": _file(rows, p("id"), F.coalesce(p("name"), F.lit("")), F.col("p.file.mimeType"), p("size"), p("lastModifiedDateTime"), created=p("createdDateTime"), folders=F.array(F.coalesce(F.col("p.parentReference.id"), F.lit(""))), owner=F.lit("onedrive:me"), deleted=F.coalesce(p("@deleted"), p("@removed").isNotNull()), extra=_map(e_tag=p("eTag")))}


def dropbox(raw: DataFrame) -> dict[str, DataFrame]:
    p = lambda c: F.col("p").getField(c)
    tag, path = F.coalesce(p(".tag"), F.lit("file")), F.coalesce(p("path_display"), F.lit(""))
    folders = F.filter(F.split(F.regexp_replace(path, "/[^/]*$", ""), "/"), lambda s: s != "")
    rows = parsed(raw, "dropbox", DROPBOX).where(tag != "folder")
    return {"files": _file(rows, p("id"), F.coalesce(p("name"), F.lit("")), _mime_of(p("name")), p("size"), p("server_modified"), path=path, folders=folders, owner=F.lit("dropbox:me"), checksum=F.coalesce(F.concat(F.lit("dropbox:"), p("rev")), F.lit("")), deleted=tag == "deleted", extra=_map(rev=p("rev")))}


def _note(rows, note_id, title, body, edited, created, **more) -> DataFrame:
    none = F.lit("")
    cols = {"_id": _id(note_id), "kind": F.lit("note"), "provider": F.col("provider"), "provider_page_id": note_id, "title": title, "body_text": body, "body_hash": content_hash(body), "url": more.get("url", none), "parent_id": F.coalesce(more.get("parent", none), none), "block_count": more.get("blocks", F.lit(0)).cast("bigint"), "tags": more.get("tags", F.array()).cast("array<string>"), "last_edited": edited, "created_ts": created, "extra": more.get("extra", F.create_map()).cast("map<string,string>"), "lineage": _lineage(rows)}
    return rows.select(*[c.alias(n) for n, c in cols.items()])


def notion(raw: DataFrame) -> dict[str, DataFrame]:
    """Blocks to markdown; a block's content hangs under a field named like its type, hence VARIANT paths."""
    rows = raw.where(F.col("provider") == "notion").withColumn("v", F.try_parse_json("payload")).where(F.col("v").isNotNull())
    at = lambda path, kind="string": F.try_variant_get("v", path, kind)
    block = "struct<type:string,heading_1:struct<rich_text:array<struct<plain_text:string>>>,heading_2:struct<rich_text:array<struct<plain_text:string>>>,heading_3:struct<rich_text:array<struct<plain_text:string>>>,bulleted_list_item:struct<rich_text:array<struct<plain_text:string>>>,to_do:struct<rich_text:array<struct<plain_text:string>>,checked:boolean>,paragraph:struct<rich_text:array<struct<plain_text:string>>>,quote:struct<rich_text:array<struct<plain_text:string>>>,callout:struct<rich_text:array<struct<plain_text:string>>>,code:struct<rich_text:array<struct<plain_text:string>>>,numbered_list_item:struct<rich_text:array<struct<plain_text:string>>>>"
    parsed_ = F.from_json("payload", f"_blocks array<{block}>, properties map<string,struct<type:string,title:array<struct<plain_text:string>>>>")
    rows = rows.withColumn("b", F.coalesce(parsed_["_blocks"], F.array())).withColumn("props", parsed_["properties"])
    joined = lambda texts: F.btrim(F.array_join(F.transform(texts, lambda t: F.coalesce(t["plain_text"], F.lit(""))), ""))
    kinds = ["heading_1", "heading_2", "heading_3", "bulleted_list_item", "to_do", "paragraph", "quote", "callout", "code", "numbered_list_item"]
    text = lambda b: F.coalesce(*[F.when(b["type"] == k, joined(b[k]["rich_text"])) for k in kinds], F.lit(""))
    lead = lambda b: F.when(b["type"] == "heading_1", "\n# ").when(b["type"] == "heading_2", "\n## ").when(b["type"] == "heading_3", "\n### ").when(b["type"] == "bulleted_list_item", "- ").when(b["type"] == "to_do", F.when(b["to_do"]["checked"], "- [x] ").otherwise("- [ ] ")).otherwise("")
    lines = F.transform(F.filter("b", lambda b: text(b) != ""), lambda b: F.concat(lead(b), text(b)))
    title = F.get(F.filter(F.transform(F.map_values("props"), lambda p: F.when(p["type"] == "title", joined(p["title"]))), lambda t: t.isNotNull()), F.lit(0))
    out = _note(rows, at("$.id"), F.when(F.coalesce(title, F.lit("")) == "", "Untitled").otherwise(title), clean_text(F.array_join(lines, "\n"), "markdown"), at("$.last_edited_time"), at("$.created_time"), parent=F.coalesce(at("$.parent.page_id"), at("$.parent.database_id")), url=F.coalesce(at("$.url"), F.lit("")), blocks=F.size("b"), extra=_map(icon=at("$.icon.emoji")))
    return {"notes": out}


def evernote(raw: DataFrame) -> dict[str, DataFrame]:
    p = lambda c: F.col(f"p.{c}")
    body = clean_text(p("content"), "markdown")
    at = lambda c: iso(F.timestamp_millis(p(c)))
    lines = F.length(body) - F.length(F.regexp_replace(body, "\n", "")) + 1
    tags = F.transform(F.coalesce(p("tagResources.tag"), F.array()), lambda t: t["name"])
    return {"notes": _note(parsed(raw, "evernote", EVERNOTE), F.coalesce(p("guid"), p("key")), clean_text(p("title")), body, at("updated"), at("created"), parent=F.coalesce(p("notebookGuid"), F.col("stream")), blocks=lines, tags=tags)}


def duration_seconds(c: Column) -> Column:
    """PT#H#M#S to seconds; 0 where it does not fit."""
    n = lambda i: F.coalesce(F.nullif(F.regexp_extract(c, r"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?", i), F.lit("")).cast("bigint"), F.lit(0))
    return F.coalesce(n(1) * 3600 + n(2) * 60 + n(3), F.lit(0))


def caption_segments(c: Column) -> Column:
    """array of segments (idx, start_ms, end_ms, start_s, text) of SRT or VTT captions."""
    rx = r"(\d{2}):(\d{2}):(\d{2})[,.](\d{3})\s*-->\s*(\d{2}):(\d{2}):(\d{2})[,.](\d{3})"
    ms = lambda t, k: ((F.regexp_extract(t, rx, k).cast("bigint") * 60 + F.regexp_extract(t, rx, k + 1).cast("bigint")) * 60 + F.regexp_extract(t, rx, k + 2).cast("bigint")) * 1000 + F.regexp_extract(t, rx, k + 3).cast("bigint")
    lines = lambda block: F.filter(F.transform(F.split(block, "\n"), lambda x: F.btrim(x)), lambda x: x != "")
    timed = lambda ls: F.when(F.get(ls, F.lit(0)).rlike(rx), 0).when(F.get(ls, F.lit(1)).rlike(rx), 1)
    blocks = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\n\s*\n"), lines), lambda ls: timed(ls).isNotNull() & (F.size(ls) > timed(ls) + 1))
    one = lambda ls, i: F.struct(i.alias("idx"), ms(F.get(ls, timed(ls)), 1).alias("start_ms"), ms(F.get(ls, timed(ls)), 5).alias("end_ms"), F.round(ms(F.get(ls, timed(ls)), 1) / 1000.0, 1).alias("start_s"), F.array_join(F.slice(ls, timed(ls) + 2, F.size(ls)), " ").alias("text"))
    return F.transform(blocks, one)


def youtube(raw: DataFrame) -> dict[str, DataFrame]:
    p = lambda c: F.col(f"p.{c}")
    rows = parsed(raw, "youtube", YOUTUBE).withColumn("vid", F.coalesce(F.try_variant_get(F.try_parse_json("payload"), "$.id.videoId", "string"), F.when(~F.startswith(F.coalesce(p("id"), F.lit("{")), F.lit("{")), p("id")), F.col("raw_id")))
    title = F.coalesce(p("snippet.title"), p("title"), F.lit(""))
    video = rows.select(_id(F.col("vid")).alias("_id"), F.lit("video").alias("kind"), "provider", F.col("vid").alias("provider_video_id"), title.alias("title"), F.substring(F.coalesce(p("snippet.description"), F.lit("")), 1, 2000).alias("description"), p("snippet.channelId").alias("channel_id"), p("snippet.channelTitle").alias("channel_title"), p("snippet.publishedAt").alias("published_ts"), duration_seconds(F.coalesce(p("snippet.duration"), F.lit(""))).alias("duration_s"), F.coalesce(p("snippet.tags"), F.array()).alias("tags"), F.coalesce(p("_playlist_label"), F.lit("")).alias("playlist_label"), _lineage(rows).alias("lineage"))
    lang = F.coalesce(p("_caption_lang"), F.lit("en"))
    t = rows.where(p("_caption_srt").isNotNull()).withColumn("segments", caption_segments(p("_caption_srt"))).withColumn("text", F.array_join(F.transform("segments", lambda s: s["text"]), " "))
    key = F.concat_ws(":", F.col("vid"), lang)
    transcript = t.select(_id(key).alias("_id"), F.lit("transcript").alias("kind"), "provider", key.alias("provider_transcript_id"), F.col("vid").alias("video_id"), title.alias("title"), lang.alias("language"), F.size("segments").cast("bigint").alias("seg_count"), "text", content_hash("text").alias("text_hash"), "segments", _lineage(t).alias("lineage"))
    return {"videos": video, "transcripts": transcript}


NORMALIZERS: dict[str, Callable[[DataFrame], dict[str, DataFrame]]] = {f.__name__: f for f in (slack, gmail, discord, whatsapp, gdrive, onedrive, dropbox, notion, evernote, youtube)}


def unpack_export(zip_path: str, folder: str) -> list[str]:
    """Chat exports: the text and media of a zip, written below folder; entries that would leave it are refused."""
    import os
    import zipfile

    root, out = os.path.realpath(folder), []
    with zipfile.ZipFile(zip_path) as z:
        for entry in z.infolist():
            if entry.is_dir() or "__MACOSX" in entry.filename or os.path.basename(entry.filename).startswith("."):
                continue
            if entry.filename.rsplit(".", 1)[-1].lower() not in {"txt", *MIME}:
                continue
            target = os.path.realpath(os.path.join(root, entry.filename))
            if os.path.commonpath([root, target]) != root:
                raise ValueError(f"{entry.filename} would be written outside {folder}")
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "wb") as f:
                f.write(z.read(entry))
            out.append(target)
    return out


def normalize(raw: DataFrame) -> dict[str, DataFrame]:
    """Silver tables by name of all providers' rows."""
    out: dict[str, DataFrame] = {}
    for run in NORMALIZERS.values():
        for name, df in run(raw).items():
            out[name] = out[name].unionByName(df, allowMissingColumns=True) if name in out else df
    return out
