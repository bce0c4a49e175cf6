"""Secret scan with linking of the parts of a credential, by DataFrame functions only.

Base findings (fixed patterns, always reported): ``assign``, a value given to
a name that stands for a secret; ``access``, an access identifier; ``hex``, a
long hexadecimal number.

Weak candidates say nothing alone: ``secret``, a bare 40-character mixed
string or a short value given to a secret's name; ``identifier``, a name given
to a user, login, account or client; ``endpoint``, an address with a scheme.
Each has a role (identifier, secret or endpoint), and so has every base
finding.  They are linked by an interval join: a weak candidate is reported
only when the scope around it, ``scope`` code points to either side, holds
its complement: a secret for an identifier, an identifier or endpoint for a
secret, and both of the others for an endpoint.  The join runs along each
text's parts in order, forth for the nearest part of every role before and
back for the nearest behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repsight.llm.common import FOLD_BLOCK, fold_sql

# The base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

#: Kinds in the order that settles equal starts.
KINDS = ("assign", "access", "hex", "secret", "identifier", "endpoint")

_BARE = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]{0,39}[0-9])(?=[A-Za-z0-9+/]{0,39}[a-z])(?=[A-Za-z0-9+/]{0,39}[A-Z])([A-Za-z0-9+/]{40})(?![A-Za-z0-9+/=_-])"
_IDENTIFIER = r"""(?i:\b(user_?name|user|login|account|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{3,64})"""
_ENDPOINT = r"""()([A-Za-z][A-Za-z0-9+]{1,11}://[A-Za-z0-9][^\s"'<>]{3,})"""

SPANS = "secret_spans"  # the column that findings adds
_PART = "array<struct<start:int,end:int,kind:int,role:string>>"


def _found(regex: str, kind: int, role: str, keep: str, group: int) -> Column:
    """Parts of one kind: leftmost matches that do not overlap, of which those stay that pass ``keep`` (on m: what is before the match, the match, its group)."""
    quoted = "'" + regex.replace("\\", "\\\\").replace("'", "\\'") + "'"
    items = f"arrays_zip(split(text, {quoted}, -1), regexp_extract_all(text, {quoted}, 0), regexp_extract_all(text, {quoted}, {group}))"
    start = "acc.st.at + length(x['0'])"
    end = f"{start} + length(x['1'])"
    part = f"named_struct('start', {start}, 'end', {end}, 'kind', {kind}, 'role', '{role}')"
    kept = keep.replace("m[", "x[")
    return F.expr(fold_sql(
        items, _PART, f"named_struct('at', coalesce({end}, acc.st.at))",
        f"CASE WHEN x['1'] IS NOT NULL AND {kept} THEN array({part}) ELSE cast(array() AS {_PART}) END", "named_struct('at', 0)",
    ))


def _none() -> Column:
    return F.expr(f"cast(array() AS {_PART})")


_ORDER = "(a, b) -> CASE WHEN a.start != b.start THEN a.start - b.start WHEN a.kind != b.kind THEN a.kind - b.kind ELSE a.end - b.end END"


def _near(parts: str, forth: bool) -> str:
    """The parts with the nearest end of every role before them (``forth``), or the nearest start behind them."""
    edge, far, best = ("end", -1000000000, "greatest") if forth else ("start", 1000000000, "least")
    side = "b" if forth else "f"
    fields = "'start', x.start, 'end', x.end, 'kind', x.kind, 'role', x.role"
    kept = "" if forth else ", 'bi', x.bi, 'bs', x.bs, 'be', x.be"
    kind = "start:int,end:int,kind:int,role:string" + ("" if forth else ",bi:int,bs:int,be:int")
    kind += f",{side}i:int,{side}s:int,{side}e:int"
    reach = lambda name, role: f"'{name}', CASE WHEN x.role = '{role}' THEN {best}(acc.st.{name}, x.{edge}) ELSE acc.st.{name} END"
    return fold_sql(
        parts, f"array<struct<{kind}>>",
        f"named_struct({reach('i', 'identifier')}, {reach('s', 'secret')}, {reach('e', 'endpoint')})",
        f"array(named_struct({fields}{kept}, '{side}i', acc.st.i, '{side}s', acc.st.s, '{side}e', acc.st.e))",
        f"named_struct('i', {far}, 's', {far}, 'e', {far})",
    )


def findings(docs: DataFrame, scope: int = 200) -> DataFrame:
    """Every row of ``docs`` with all its columns and ``secret_spans``: array of (start, end, kind).

    Spans are in code points, end exclusive, in order of start and kind; their
    kind is a number in ``KINDS``.  ``docs`` needs text; a null text counts as
    empty, repeated rows come back repeated, an empty table gives no row.  A
    column of ``docs`` named secret_spans is replaced; all others are kept,
    whatever their names.  The plan is one projection, without exchange.
    """
    docs = docs.drop(SPANS)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    given = docs.select(F.struct("*").alias("row"), text.alias("text"))
    named = F.col("text").rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]")
    hexed = F.col("text").rlike(r"[0-9a-f]{16}")
    keyed = F.col("text").contains("AKIA")
    # only a run of 16 and 18 characters can pass, and runs are matched whole, so the shorter need not be listed
    base = given.select(
        "row", "text",
        F.when(named, _found(ASSIGN, 0, "secret", "length(m['2']) >= 12", 2)).otherwise(_none()).alias("a0"),
        F.when(keyed, _found(f"({ACCESS})", 1, "identifier", "length(m['1']) >= 18", 1)).otherwise(_none()).alias("a1"),
        F.when(hexed, _found(r"([0-9a-f]{16,})", 2, "secret", "true", 1)).otherwise(_none()).alias("a2"),
        F.when(named, _found(ASSIGN, 3, "secret", "length(m['2']) between 8 and 11", 2)).otherwise(_none()).alias("w0"),
        F.when(
            F.col("text").rlike(r"(?i)(user_?name|user|login|account|client_?id|access_?key_?id)[\"']?\x20*[:=]"),
            _found(_IDENTIFIER, 4, "identifier", "true", 2),
        ).otherwise(_none()).alias("w1"),
        F.when(F.col("text").contains("://"), _found(_ENDPOINT, 5, "endpoint", "true", 2)).otherwise(_none()).alias("w2"),
    )
    # a bare string needs an identifier or an endpoint somewhere
    bare = F.when(
        F.size("a1") + F.size("w1") + F.size("w2") > 0, _found(_BARE, 3, "secret", "true", 1)
    ).otherwise(_none())
    parts = base.select("row", *(f"a{i}" for i in range(3)), F.concat("w0", "w1", "w2", bare).alias("weak"))
    parts = parts.withColumn("base", F.concat("a0", "a1", "a2"))
    ordered = f"array_sort(concat(base, weak), {_ORDER})"
    linked = F.expr(f"CASE WHEN size(weak) > 0 THEN {_near(ordered, True)} END")
    parts = parts.withColumn("forth", linked)
    both = F.expr(f"CASE WHEN size(forth) > 0 THEN {_near('reverse(forth)', False)} END")
    parts = parts.withColumn("both", both)

    def has(role: str) -> str:
        return f"(p.start - p.b{role} <= {scope} OR p.f{role} - p.end <= {scope})"

    linked = F.expr(f"""
filter(both, p -> p.kind >= 3 AND CASE p.role
  WHEN 'identifier' THEN {has('s')} WHEN 'secret' THEN {has('i')} OR {has('e')} ELSE {has('i')} AND {has('s')} END)""")
    parts = parts.withColumn("linked", F.coalesce(F.transform(linked, lambda p: F.struct(
        p["start"].alias("start"), p["end"].alias("end"), p["kind"].alias("kind"), p["role"].alias("role"))), _none()))
    # in order, each span once: equal ones are neighbours
    span = "named_struct('start', x.start, 'end', x.end, 'kind', x.kind)"
    kind = "array<struct<start:int,end:int,kind:int>>"
    again = "acc.st.start = x.start AND acc.st.end = x.end AND acc.st.kind = x.kind"
    spans = F.expr(fold_sql(
        f"array_sort(concat(base, linked), {_ORDER})", kind, span,
        f"CASE WHEN {again} THEN cast(array() AS {kind}) ELSE array({span}) END", "named_struct('start', -1, 'end', -1, 'kind', -1)",
    ))
    return parts.select("row.*", spans.alias(SPANS))


def digest(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(docs: DataFrame, scope: int = 200, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark`` (overlapping spans by one), and n_chars counted anew.

    Texts without a finding, null ones included, stay as they are, as does their n_chars; repeated rows and all other
    columns are kept, whatever their names, and an empty table stays empty.
    """
    given = docs.select(F.struct("*").alias("row"), F.col("text"))
    found = findings(given, scope)
    # block by block of spans: the text from the block before up to this one's end, and its pieces between the spans
    pieces = f"""
aggregate(sequence(0, (size({SPANS}) - 1) div {FOLD_BLOCK}), named_struct('at', 0, 'out', cast(array() AS array<array<string>>)),
  (o, b) -> transform(array(slice({SPANS}, b * {FOLD_BLOCK} + 1, {FOLD_BLOCK})), blk -> transform(
    array(substring(text, o.at + 1, array_max(transform(blk, s -> s.end)) - o.at)), seg -> transform(
      array(aggregate(blk, named_struct('at', o.at, 'part', cast(array() AS array<string>)), (acc, s) -> CASE
        WHEN s.end <= acc.at THEN acc
        WHEN s.start < acc.at THEN named_struct('at', s.end, 'part', acc.part)
        ELSE named_struct('at', s.end, 'part', concat(acc.part, array(substring(seg, acc.at - o.at + 1, s.start - acc.at), '{mark}'))) END)),
      i -> named_struct('at', i.at, 'out', concat(o.out, array(i.part))))[0])[0])[0],
  o -> concat(array_join(flatten(o.out), ''), substring(text, o.at + 1)))"""
    some = F.size(SPANS) > 0
    out = found.select("row", some.alias("some"), F.when(some, F.expr(pieces)).otherwise(F.col("text")).alias("clean"))
    columns = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("some"), F.length("clean").cast("long")).otherwise(F.col("row")["n_chars"])
    return out.select(*(columns[c].alias(c) for c in docs.columns))
