"""Integrity reports and row-rule validation with quarantine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# J10 ---------------------------------------------------------------------
def orphan_report(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose key has no row in ``parent`` (left anti join)."""
    p = parent.select(F.col(parent_key).alias("__pk"))
    return child.join(p, child[child_key] == p["__pk"], "left_anti")


# A3 ----------------------------------------------------------------------
def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once (PRIMARY KEY / UNIQUE as a report)."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
              .filter(F.col("n") > 1))


# Q1 / Q2 / Q3 / P8 -------------------------------------------------------
Rule = tuple[str, Column]  # (name, violated-when condition)


def violations(rules: Sequence[Rule], first_per_field: bool = True) -> Column:
    """Array of the names of violated rules, in rule order.

    Rule names are ``field:rule``.  Like the service's validator, only the
    first failing rule of a field is reported unless ``first_per_field`` is
    off (then every failing rule is listed).
    """
    if not first_per_field:
        items = [F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules]
        return F.filter(F.array(*items), lambda x: x.isNotNull())
    chains: dict[str, Column] = {}
    for name, cond in rules:  # one CASE chain per field: later rules are not evaluated
        field = name.split(":", 1)[0]
        c = F.coalesce(cond, F.lit(False))
        chains[field] = chains[field].when(c, F.lit(name)) if field in chains else F.when(c, F.lit(name))
    return F.filter(F.array(*chains.values()), lambda x: x.isNotNull())


def validate(df: DataFrame, rules: Sequence[Rule], first_per_field: bool = True) -> DataFrame:
    """Add ``violations`` (array) and ``valid``; one pass, no shuffle."""
    return (df.withColumn("violations", violations(rules, first_per_field))
              .withColumn("valid", F.size("violations") == 0))


def split_valid(df: DataFrame, rules: Sequence[Rule],
                first_per_field: bool = True) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantine) over the same validated plan."""
    v = validate(df, rules, first_per_field)
    return v.filter("valid").drop("violations", "valid"), v.filter(~F.col("valid"))


# Rule builders mirroring the request field tags.
def required(c: Column) -> Column:
    return c.isNull() | (c == "")


def too_short(c: Column, n: int) -> Column:
    return F.char_length(c) < n


def too_long(c: Column, n: int) -> Column:
    return F.char_length(c) > n


def not_alphanumeric(c: Column) -> Column:
    return ~c.rlike(r"^[a-zA-Z0-9]+\z")


def lacks_any(c: Column, chars: str) -> Column:
    cls = "".join("\\" + ch for ch in chars)
    return ~c.rlike(f"[{cls}]")


# The characters of an address, as the service's validator has them.
_UC = "\u00a0-\ud7ff\uf900-\ufdcf\ufdf0-\uffef"
_ATOM = rf"[a-zA-Z0-9!#$%&'*+\-/=?^_`{{|}}~{_UC}]+"
_QUOTED = rf'"(?:[ \t!#-\[\]-~{_UC}]|\\[ \t!-~{_UC}])+"'
_INNER, _ALNUM, _ALPHA = (rf"[{c}{_UC}]" for c in (r"a-zA-Z0-9\-._~", "a-zA-Z0-9", "a-zA-Z"))


def not_email(c: Column) -> Column:
    """Whether a text is no address for the service's validator.

    Before the last ``@``: atoms joined by single dots, or a quoted text.  After it: letters, digits and ``- . _ ~``, beginning with a
    letter or digit and ending with a letter, with a dot somewhere between a letter or digit and a letter, and no two dots together.
    Every test is one linear pass.
    """
    at = F.instr(F.reverse(c), "@")
    local, domain = F.substring(c, F.lit(1), F.char_length(c) - at), F.substring_index(c, "@", -1)
    ok = ((at > 0) & (local.rlike(rf"^{_ATOM}(?:\.{_ATOM})*\z") | local.rlike(rf"^{_QUOTED}\z")) & domain.rlike(rf"^{_ALNUM}{_INNER}*\z")
          & domain.rlike(rf"{_ALNUM}\.{_ALPHA}") & domain.rlike(rf"{_ALPHA}\z") & ~domain.contains(".."))
    return ~ok


def not_equal(a: Column, b: Column) -> Column:
    return ~F.coalesce(a == b, F.lit(False))


def password_rules(field: str) -> list[Rule]:
    c = F.col(field)
    return [(f"{field}:required", required(c)), (f"{field}:min", too_short(c, 5)),
            (f"{field}:max", too_long(c, 70)), (f"{field}:containsany", lacks_any(c, "!@#$%^&*"))]


def signup_rules() -> list[Rule]:
    u, n, e = F.col("username"), F.col("fullname"), F.col("email")
    return [("username:required", required(u)), ("username:min", too_short(u, 4)),
            ("username:max", too_long(u, 20)), ("username:alphanum", not_alphanumeric(u)),
            ("fullname:required", required(n)), ("fullname:min", too_short(n, 4)),
            ("fullname:max", too_long(n, 100)),
            ("email:required", required(e)), ("email:email", not_email(e)), ("email:max", too_long(e, 50)),
            *password_rules("password"),
            ("confirm_password:eqfield", not_equal(F.col("confirm_password"), F.col("password")))]


def email_rules(field: str = "email") -> list[Rule]:
    e = F.col(field)
    return [(f"{field}:required", required(e)), (f"{field}:email", not_email(e)), (f"{field}:max", too_long(e, 50))]


def _confirmed(rules: list[Rule]) -> list[Rule]:
    return [*rules, ("confirm_password:eqfield", not_equal(F.col("confirm_password"), F.col("password")))]


#: The request records of the service and the rules of their fields.
RECORD_RULES = {
    "signup": lambda: signup_rules(),
    "login": lambda: [*email_rules(), *password_rules("password")],
    "reset_password": lambda: _confirmed([("token:required", required(F.col("token"))), ("token:max", too_long(F.col("token"), 50)),
                                          *password_rules("password")]),
    "forgot_password": lambda: email_rules(),
    "resend_verify": lambda: email_rules(),
    "change_password": lambda: _confirmed([("current_password:required", required(F.col("current_password"))),
                                           ("current_password:min", too_short(F.col("current_password"), 5)),
                                           ("current_password:max", too_long(F.col("current_password"), 70)),
                                           *password_rules("password")]),
    "delete_user": lambda: password_rules("password"),
    "upload": lambda: [("filename:required", required(F.col("filename"))), ("content_type:required", required(F.col("content_type")))],
    "upload_confirm": lambda: [("key:required", required(F.col("key"))), ("filename:required", required(F.col("filename")))],
    # the payload of an access token: none of these may be empty
    "token_payload": lambda: [(f"{f}:required", required(F.col(f))) for f in ("fullname", "email", "role")],
}


def record_rules(record: str) -> list[Rule]:
    """The rules of one of the service's records (see ``RECORD_RULES``)."""
    return RECORD_RULES[record]()


#: Longest texts of the service's tables, and the values a column may take.
TEXT_LIMITS = {
    "users": {"username": 21, "fullname": 100, "email": 50, "password_hash": 70, "role": 6},
    "verifier": {"token_hash": 70}, "reseter": {"token_hash": 70}, "profiles": {"profile_pic": 70},
    "anon_users": {"username": 200, "fullname": 200, "role": 6}, "anon_profiles": {"profile_pic": 70},
}
ALLOWED = {"shares": {"access": ["view", "download"]}}


def table_rules(table: str, schema) -> list[Rule]:
    """NOT NULL, length and allowed-value rules of a service table; ``schema`` is its schema in ``sources.tables``."""
    rules: list[Rule] = []
    for f in schema.fields:
        c = F.col(f.name)
        if not f.nullable:
            rules.append((f"{f.name}:notnull", c.isNull()))
        if f.name in TEXT_LIMITS.get(table, {}):
            rules.append((f"{f.name}:max", too_long(c, TEXT_LIMITS[table][f.name])))
        if f.name in ALLOWED.get(table, {}):
            rules.append((f"{f.name}:oneof", ~c.isin(ALLOWED[table][f.name])))
    return rules


def conversion_rules(start: Column, end: Column, fps: Column, width: Column,
                     max_fps: int = 5, max_width: int = 1920) -> list[Rule]:
    """Checks the service lists as missing: start < end, fps and width bounds."""
    return [("start_before_end", ~(start < end)),
            ("fps_range", (fps < 0) | (fps > max_fps)),
            ("width_range", (width < 0) | (width > max_width))]
