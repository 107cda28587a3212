"""Tokens that link without revealing, sealed values, and keys."""

from __future__ import annotations

import hashlib
import hmac
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..schema import EXTRA, SEGMENT
from .text import RE_EMAIL, text_of

_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def normalize_email(c, fold_google: bool = False) -> Column:
    out = F.lower(F.btrim(text_of(c)))
    if not fold_google:
        return out
    local, host = F.substring_index(out, "@", 1), F.substring_index(out, "@", -1)
    folded = F.concat(F.replace(F.substring_index(local, "+", 1), F.lit("."), F.lit("")), F.lit("@"), host)
    return F.when(out.contains("@") & host.isin("gmail.com", "googlemail.com"), folded).otherwise(out)


def normalize_phone(c) -> Column:
    t = F.btrim(text_of(c))
    digits = F.regexp_replace(t, r"\D+", "")
    return F.when(F.length(digits) < 7, "").otherwise(F.concat(F.when(t.startswith("+"), "+").otherwise(""), digits))


def normalize_name(c) -> Column:
    out = F.translate(F.lower(text_of(c)), _ACCENTED, _PLAIN)
    return F.btrim(F.regexp_replace(F.regexp_replace(out, r"[^a-z0-9 ]+", ""), r"\s+", " "))


@F.pandas_udf(StringType())
def fold_accents(s: pd.Series) -> pd.Series:
    """Every accent, for names beyond the letters that normalize_name() folds."""
    return s.map(lambda x: "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch)), na_action="ignore")


def is_email(c) -> Column:
    return text_of(c).rlike(f"^{RE_EMAIL.removeprefix(chr(92) + 'b').removesuffix(chr(92) + 'b')}$")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC, composed of sha2 as there is no built-in; the key's pads are literals of the plan."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in block) for x in (0x36, 0x5C))
    digest = F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(digest)), 256)


def identity_token(pepper: bytes, kind: str, value: Column) -> Column:
    """Deterministic token of a normalised value; null where there is none."""
    token = F.concat(F.lit("dd_"), F.substring(hmac_sha256(pepper, F.concat(F.lit(f"{kind}|"), value)), 1, 32))
    return F.when(value != "", token)


def aad_of(workspace: str, doc_id: Column, field: str) -> Column:
    return F.concat(F.lit(f"{workspace}|"), doc_id, F.lit(f"|{field}|v1"))


def seal(value, key: bytes, workspace: str, doc_id: Column, field: str, kid: str = "k1") -> Column:
    """struct(v, alg, kid, ct, aad): AES-GCM bound to its place by the additional data. A random nonce leads ct."""
    aad = aad_of(workspace, doc_id, field)
    ct = F.aes_encrypt(text_of(value).cast("binary"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), aad.cast("binary"))
    return F.struct(F.lit(1).alias("v"), F.lit("AES-GCM").alias("alg"), F.lit(kid).alias("kid"), F.base64(ct).alias("ct"), F.sha2(aad, 256).alias("aad"))


def unseal(sealed: Column, key: bytes, workspace: str, doc_id: Column, field: str, kid: str = "k1") -> Column:
    """The value, or null where key, place or bytes do not fit."""
    aad = aad_of(workspace, doc_id, field)
    plain = F.try_aes_decrypt(F.unbase64(sealed["ct"]), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), aad.cast("binary")).cast("string")
    return F.when((sealed["kid"] == kid) & (sealed["aad"] == F.sha2(aad, 256)), plain)


def hkdf(secret: bytes, info: bytes, salt: bytes = b"", length: int = 32) -> bytes:
    """RFC 5869 with SHA-256."""
    prk = hmac.new(salt or bytes(32), secret, hashlib.sha256).digest()
    out, block = b"", b""
    for i in range(-(-length // 32)):
        block = hmac.new(prk, block + info + bytes([i + 1]), hashlib.sha256).digest()
        out += block
    return out[:length]


class KeyRing:
    """Keys of a workspace, all derived from one master key."""

    def __init__(self, master: bytes, workspace: str):
        self.workspace = workspace
        self.wrapping = hkdf(master, f"wkek|{workspace}".encode())

    def data_key(self, source: str) -> bytes:
        return hkdf(self.wrapping, f"dek|{source}".encode())

    def pepper(self) -> bytes:
        return hkdf(self.wrapping, b"identity-pepper")

    def fingerprint(self) -> str:
        return hashlib.sha256(self.wrapping).hexdigest()[:16]


#: Fields that are stored sealed, and their types, by table.
SEALED_FIELDS = {
    "messages": {"body_text": "string", "extra": EXTRA},
    "notes": {"body_text": "string"},
    "transcripts": {"text": "string", "segments": f"array<{SEGMENT}>"},
    "videos": {"description": "string"},
    "identities": {"email": "string", "phone": "string"},
    "raw_artifacts": {"payload": "string"},
    "quarantine": {"payload": "string"},
}
#: Columns that name a row, where it isn't _id.
ROW_NAME = {"raw_artifacts": "raw_id", "quarantine": "raw_id"}


def _is_sealed(df: DataFrame, field: str) -> bool:
    kind = df.schema[field].dataType
    return isinstance(kind, StructType) and "ct" in kind.names


class Sealer:
    """Seals a table's fields and opens them; nested ones as JSON, nulls as they are.

    Each value is bound to workspace, row and field. A wrong key, or a value moved elsewhere, opens as null.
    """

    def __init__(self, ring: KeyRing, table: str):
        self.fields, self.doc = SEALED_FIELDS.get(table, {}), F.col(ROW_NAME.get(table, "_id"))
        self.key, self.kid, self.workspace = ring.data_key(table), ring.fingerprint(), ring.workspace

    def close(self, df: DataFrame) -> DataFrame:
        def one(f: str, kind: str) -> Column:
            text = F.col(f) if kind == "string" else F.to_json(f, {"ignoreNullFields": "false"})
            return F.when(F.col(f).isNotNull(), seal(text, self.key, self.workspace, self.doc, f, self.kid))

        return df.withColumns({f: one(f, kind) for f, kind in self.fields.items() if f in df.columns and not _is_sealed(df, f)})

    def open(self, df: DataFrame) -> DataFrame:
        def one(f: str, kind: str) -> Column:
            text = unseal(F.col(f), self.key, self.workspace, self.doc, f, self.kid)
            return text if kind == "string" else F.from_json(text, kind)

        return df.withColumns({f: one(f, kind) for f, kind in self.fields.items() if f in df.columns and _is_sealed(df, f)})
