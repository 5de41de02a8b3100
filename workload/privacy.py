"""Tokens for the personal data of customers, and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.operators import privacy
from workload import base
from workload.base import query

PII = {"email": "email", "phone": "phone", "c_name": "name", "host": "ipv4", "iban": "iban",
       "c_mktsegment": "other"}
SALT = "a salt for the test tables"


def token_sql(kind: str, value: str) -> str:
    digest = f"sha256(concat_ws('|', '{SALT}', '{kind}', {value}))"
    parts = " || ".join(f"lpad(cast(cast('0x' || substring({digest}, {at}, 15) as bigint) "
                        "as varchar), 19, '0')" for at in (1, 16))
    prefix = base.fixed.TOKEN_PREFIXES.get(kind, "PII")
    return f"case when {value} is not null then '{prefix}-' || {parts} end"


MAPPING_SQL = "(" + " union ".join(
    f"select '{c}' as column_name, '{k}' as pii_type, {c} as value, {token_sql(k, c)} as token "
    f"from {base.CONTACTS_SQL} where {c} is not null" for c, k in PII.items()) + ")"
SAFE_SQL = (f"(select c_custkey, age, {', '.join(f'{token_sql(k, c)} as {c}' for c, k in PII.items())} "
            f"from {base.CONTACTS_SQL})")


def protected(spark, sf):
    return privacy.pseudonymize(base.contacts(spark, sf), PII, SALT)


@query("P1_token_mapping", f"select * from {MAPPING_SQL}")
def _(spark, sf):
    return privacy.token_mapping(base.contacts(spark, sf), PII, SALT)


@query("P1_pseudonymized", f"select * from {SAFE_SQL}")
def _(spark, sf):
    return protected(spark, sf)[0].select("c_custkey", "age", *PII)


@query("P2_reidentified", f"""
select c_custkey, concat('Write to ', coalesce(email, 'nobody'), ' or call ', phone,
    '; not TEL-9x, EMAIL-99 or XTEL-001; again ', coalesce(email, 'nobody'), '.') as note,
  concat(c_name, ' (', c_mktsegment, ')') as title
from {base.CONTACTS_SQL} c
""")
def _(spark, sf):
    safe, mapping = protected(spark, sf)
    texts = safe.select(
        "c_custkey",
        F.concat(F.lit("Write to "), F.coalesce("email", F.lit("nobody")), F.lit(" or call "),
                 "phone", F.lit("; not "), F.lit("TEL-9x, EMAIL-99 or XTEL-001; again "),
                 F.coalesce("email", F.lit("nobody")), F.lit(".")).alias("note"),
        F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")")).alias("title"),
    )
    return privacy.reidentify(texts, mapping, "c_custkey", ["note", "title"])


@query("P2_reidentified_repeated_ids", """
select conv_id, turn, concat('about ', role, ': ', role, '.') as note from conversations
""")
def _(spark, sf):
    talk = base.table(spark, sf, "conversations")
    safe, mapping = privacy.pseudonymize(talk, {"role": "name"}, SALT)
    texts = safe.select("conv_id", "turn", F.concat(
        F.lit("about "), "role", F.lit(": "), "role", F.lit(".")).alias("note"))
    return privacy.reidentify(texts, mapping, "conv_id", ["note"])


@query("P3_privacy_audit", f"""
select column_name, pii_type, 'pseudonymisation' as method, count(*) as values_protected
from {MAPPING_SQL} group by all
""")
def _(spark, sf):
    return privacy.privacy_audit(privacy.token_mapping(base.contacts(spark, sf), PII, SALT))
