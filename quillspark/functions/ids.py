"""Hashes and identifiers as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

OID = "6ba7b8129dad11d180b400c04fd430c8"  # RFC 4122 namespace


def normalised_hash(text: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " ")), 256)


def uuid5(seed: Column, namespace: str = OID) -> Column:
    """RFC 4122 version 5 id of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(seed, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab89ab89ab89ab"]), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1)
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12))


def chunk_id(project: Column, chunk_hash: Column) -> Column:
    return uuid5(F.concat(project, F.lit("::"), chunk_hash))


def fqn(*parts: Column) -> Column:
    return F.concat_ws("::", *[F.nullif(p, F.lit("")) for p in parts])


def rbac_hash(user: Column, projects: Column, roles: Column | None = None) -> Column:
    """First 16 hex digits over user and sorted projects; roles join in unless None (compatible form)."""
    key = F.concat(user, F.lit(":"), F.array_join(F.array_sort(projects), ":"))
    key = key if roles is None else F.concat(key, F.lit("|"), F.array_join(F.array_sort(roles), ":"))
    return F.substring(F.sha2(key, 256), 1, 16)


def collection(project: Column, version: Column) -> Column:
    return F.concat(project, F.lit("__"), F.translate(version, "./", "--"))


def repository_name(url: Column) -> Column:
    return F.replace(F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1), F.lit(".git"), F.lit(""))


@F.pandas_udf(BooleanType())
def signature_valid(body: pd.Series, signature: pd.Series, secret: pd.Series) -> pd.Series:
    """HMAC-SHA256 of the raw body for sha256= signatures, else equality with the secret token."""
    import hashlib
    import hmac

    def one(b, s, k):
        if not s or not k:
            return False
        if s.startswith("sha256="):
            return hmac.compare_digest(hmac.new(k.encode(), bytes(b or b""), hashlib.sha256).hexdigest(), s[7:])
        return hmac.compare_digest(s.encode(), k.encode())

    return pd.Series([one(b, s, k) for b, s, k in zip(body, signature, secret)])


@F.pandas_udf(StringType())
def signature(body: pd.Series, secret: pd.Series) -> pd.Series:
    """sha256= and the HMAC-SHA256 of a raw body."""
    import hashlib
    import hmac

    return pd.Series(["sha256=" + hmac.new(k.encode(), bytes(b or b""), hashlib.sha256).hexdigest() for b, k in zip(body, secret)])
