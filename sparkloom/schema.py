"""Canonical schemas of the silver tables; ``extra`` stays open as a map of strings."""

from __future__ import annotations

DEADLINE = "struct<sentence:string,cue:string,due:string,due_date:string,hardness:string,resolved_from:string,confidence:double>"
DATE_REF = "struct<text:string,value:string,local_date:string,kind:string,precision:string>"
MENTION = "struct<text:string,type:string,normalized:string,span_start:int,span_end:int,resolved_person_id:string,confidence:double>"
ENTITIES = f"struct<emails:array<string>,phones:array<string>,handles:array<string>,urls:array<string>,money:array<string>,file_refs:array<string>,person_ids:array<string>,dates:array<{DATE_REF}>,deadlines:array<{DEADLINE}>>"
ATTACHMENT = "struct<provider_file_id:string,name:string,mime:string,size_bytes:bigint>"
REACTION = "struct<emoji:string,count:bigint,users:array<string>>"
SEGMENT = "struct<idx:int,start_ms:bigint,end_ms:bigint,start_s:double,text:string>"
EXTRA = "map<string,string>"

MESSAGE = (
    "_id string, kind string, provider string, provider_msg_id string, conversation_id string, thread_root_id string, reply_to_id string, "
    f"sender_ref string, sender_name string, ts string, body_text string, body_hash string, lang string, direction string, attachments array<{ATTACHMENT}>, reactions array<{REACTION}>, extra {EXTRA}"
)
FILE = (
    "_id string, kind string, provider string, provider_file_id string, name string, mime string, size_bytes bigint, modified_ts string, created_ts string, path string, "
    f"folder_path array<string>, owner_ref string, shared_with array<string>, checksum string, deleted boolean, extra {EXTRA}"
)
NOTE = f"_id string, kind string, provider string, provider_page_id string, title string, body_text string, body_hash string, url string, parent_id string, block_count bigint, tags array<string>, last_edited string, created_ts string, extra {EXTRA}"
VIDEO = f"_id string, kind string, provider string, provider_video_id string, title string, description string, channel_id string, channel_title string, published_ts string, duration_s bigint, tags array<string>, playlist_label string, extra {EXTRA}"
TRANSCRIPT = f"_id string, kind string, provider string, provider_transcript_id string, video_id string, title string, language string, seg_count bigint, text string, text_hash string, segments array<{SEGMENT}>"
IDENTITY = "_id string, ref string, provider string, provider_user_id string, display_name string, email string, phone string, email_token string, phone_token string, name_token string, mention_count bigint, first_seen string, last_seen string, is_self boolean"
RAW = "raw_id string, provider string, stream string, payload string, payload_hash string, fetched_at string"

TABLE_OF_KIND = {"message": "messages", "email": "messages", "file": "files", "note": "notes", "video": "videos", "transcript": "transcripts", "identity": "identities", "membership": "memberships"}
NATURAL_KEY = {"message": "provider_msg_id", "email": "provider_msg_id", "file": "provider_file_id", "note": "provider_page_id", "video": "provider_video_id", "transcript": "provider_transcript_id", "identity": "provider_user_id"}
CONTENT_TABLES = ("messages", "files", "notes", "videos", "transcripts")
