"""Secrets in texts: strong findings by pattern, weak ones where complementary parts of a credential meet."""

from __future__ import annotations

import hashlib
import re
import uuid
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallowgrid.llm.common import bound_batches, lean, materialise

#: Strong kinds in the order in which they are listed: pattern, and the least length of group ``by``.
STRONG = {
    "assign": (re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
}
#: Weak kinds: a name or number that says who, a bare value that could be a key, a place where it is used.
#: No pattern looks around, so that RE2 reads them alike; a value must mix upper case, lower case and digits.
WEAK = {
    "ident": re.compile(r"""(?ai:access_key_id|access_key|client_id|account|username|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]{3,}"""),
    "value": re.compile(r"[A-Za-z0-9+/_=-]{20,}"),
    "endpoint": re.compile(r"(?ai:https|http|s3|postgres|mysql|redis|amqp|ftp)://[A-Za-z0-9._:@/-]{4,}"),
}
#: What a part is in a credential.
ROLES = {"assign": "secret", "hex": "secret", "value": "secret", "access": "id", "ident": "id", "endpoint": "place"}
KINDS = [*STRONG, *WEAK]
#: A weak part counts if, within this many code points of it and in its paragraph, there is a part of each role listed.
WINDOW = 200
NEEDS = {"ident": ["secret"], "value": ["id"], "endpoint": ["id", "secret"]}
_BREAK = re.compile(r"\n[ \t\r]*\n")
_MIXED = [re.compile(p) for p in ("[A-Z]", "[a-z]", "[0-9]")]
_HINT = re.compile(r"[:=]")


def strong_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the strong findings, by start and then in the order of kinds."""
    found = []
    for rank, (kind, (pattern, group, least)) in enumerate(STRONG.items()):
        if kind == "assign" and not _HINT.search(text):
            continue
        found += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(s, e, k) for s, _, e, k in sorted(found)]


def weak_spans(text: str, strong: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of weak candidates that no strong finding overlaps."""
    found, starts = [], [s for s, _, _ in strong]
    reach = list(accumulate((e for _, e, _ in strong), max))
    for kind, pattern in WEAK.items():
        for m in pattern.finditer(text):
            if kind == "value" and not all(p.search(m[0]) for p in _MIXED):
                continue
            before = bisect_left(starts, m.end())
            if not before or reach[before - 1] <= m.start():
                found.append((m.start(), m.end(), kind))
    return sorted(found)


def join_spans(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_parts(docs: DataFrame) -> DataFrame:
    """Per row: uid, doc_id, n_assign, n_access, n_hex, base_sha256, base, and parts where a weak candidate and
    some other role lie in one text; written once, so that uid names a row whatever runs again.

    A part has kind, start, end and scope, the number of its paragraph.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    part = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("scope", pa.int64())])

    def run(batches):
        own, at = uuid.uuid4().hex, 0
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                strong = strong_spans(text)
                weak = weak_spans(text, strong)
                parts = None
                if weak and len({ROLES[k] for _, _, k in [*strong, *weak]}) > 1:
                    ends = [m.end() for m in _BREAK.finditer(text)]
                    parts, scope = [], 0
                    for s, e, k in sorted([*strong, *weak]):
                        while scope < len(ends) and ends[scope] <= s:
                            scope += 1
                        parts.append({"kind": k, "start": s, "end": e, "scope": scope})
                base = join_spans(strong)
                counts = [sum(k == name for _, _, k in strong) for name in STRONG]
                out.append((f"{own}-{at}", *counts, hashlib.sha256(base.encode()).hexdigest(), base, parts))
                at += 1
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(part)]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([arrays[0], batch.column(0), *arrays[1:]], names=["uid", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "parts"])

    schema = f"uid string, doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, base string, parts array<struct<kind: string, start: long, end: long, scope: long>>"
    return materialise(rows.mapInArrow(lean(run), schema), "credential-parts")


def link_parts(parts: DataFrame, window: int = WINDOW) -> DataFrame:
    """The weak parts (uid, kind, start, end, scope) that have all the complements of NEEDS within ``window``.

    An interval join without pairs. Offsets are cut into cells as wide as the window. A part lies in each cell
    that it touches; a cell keeps, for each role, the least start and the greatest end within it. A weak part's
    reach, from ``window`` before its start to ``window`` after its end, is wider than two cells, so of each
    cell that it meets it holds the right end, the left end or all: in the first cell the greatest end, in the
    last the least start, between them the mere presence decides exactly. A part meets its cells' roles only,
    however many parts lie there.
    """
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    cells = lambda a, b: F.sequence(F.floor(a / window), F.floor((b - 1) / window))
    cell = F.col("cell") * window
    held = parts.select("uid", "scope", role[F.col("kind")].alias("role"), "start", "end", F.explode(cells(F.col("start"), F.col("end"))).alias("cell"))
    held = held.groupBy("uid", "scope", "cell", "role").agg(F.min(F.greatest("start", cell)).alias("first"), F.max(F.least("end", cell + window)).alias("last"))
    low, high = F.greatest(F.col("start") - window, F.lit(0)), F.col("end") + window
    weak = parts.where(F.col("kind").isin(*NEEDS)).select("uid", "scope", "kind", "start", "end", low.alias("low"), high.alias("high"), F.explode(cells(low, high)).alias("cell"))
    met = weak.join(held, ["uid", "scope", "cell"]).where((F.col("last") > F.col("low")) & (F.col("first") < F.col("high")))
    roles = met.groupBy("uid", "scope", "kind", "start", "end").agg(F.collect_set("role").alias("roles"))
    needs = F.create_map(*[x for k, v in NEEDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return roles.where(F.size(F.array_except(needs[F.col("kind")], "roles")) == 0).select("uid", "kind", "start", "end", "scope")


def find_secrets(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row.

    Strong findings are always reported: assignments to names of secrets, access identifiers, long
    hexadecimal runs. Weak candidates (names of users and clients, bare values of mixed characters, endpoints)
    are reported only where the parts that complete them lie within ``window`` code points in one paragraph: a
    name by a secret, a bare value by an identifier, an endpoint by both.

    Null and empty texts have nothing; whole texts are searched, however long; repeated rows and rows with
    null or equal ids are each a text of their own; no rows give none; other columns, whatever their names,
    are not read. Only rows with candidates are shuffled, without their texts.
    """
    found = find_parts(docs)
    asked = found.where(F.col("parts").isNotNull())
    linked = link_parts(asked.select("uid", F.explode("parts").alias("p")).select("uid", "p.*"), window)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct(F.col("start"), rank.alias("rank"), F.concat_ws(":", "kind", "start", "end").alias("span"))
    strong = asked.select("uid", F.explode("parts").alias("p")).select("uid", "p.*").where(F.col("kind").isin(*STRONG)).select("uid", "kind", "start", "end")
    # A row's spans are no more than its text holds.
    spans = linked.select("uid", "kind", "start", "end").unionByName(strong).groupBy("uid").agg(F.array_sort(F.collect_list(span)).alias("__spans"))
    columns = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    joined = asked.join(spans, "uid", "left").select(*columns, F.coalesce(F.array_join(F.col("__spans.span"), ","), F.lit("")).alias("spans"))
    return found.where(F.col("parts").isNull()).select(*columns, F.col("base").alias("spans")).unionByName(joined)


def _any_case(name: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name)


def _re2(pattern: re.Pattern) -> str:
    """A pattern as RE2 in an SQL string: names in either ASCII case spelt out."""
    text = re.sub(r"\(\?ai:([^)]*)\)", lambda m: "(?:" + "|".join(_any_case(n).replace("_?", "_?") for n in m[1].split("|")) + ")", pattern.pattern)
    return text.replace("'", "''")


def _spans_sql(kind: str, pattern: re.Pattern, keep: str) -> str:
    """start, end and text of all matches: lengths of matches and of what lies between them, added up."""
    p = _re2(pattern)
    return f"""SELECT doc, '{kind}' AS kind, m, list_sum(list_transform(gaps[:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[:k - 1], lambda x: length(x))), 0) AS s, length(m) AS n FROM (
 SELECT doc, ms, gaps, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS k FROM (
  SELECT doc, regexp_extract_all(text, '{p}') AS ms, regexp_split_to_array(text, '{p}') AS gaps FROM texts)) WHERE {keep}"""


_ASSIGN = _re2(STRONG["assign"][0])
_FOUND = " UNION ALL ".join(
    [
        _spans_sql("assign", STRONG["assign"][0], f"length(regexp_extract(m, '{_ASSIGN}', 1)) >= 6"),
        _spans_sql("access", STRONG["access"][0], "length(m) >= 20"),
        _spans_sql("hex", re.compile("[0-9a-f]+"), "length(m) >= 24"),
    ]
)
_CANDIDATES = " UNION ALL ".join(
    _spans_sql(k, p, "regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')" if k == "value" else "TRUE") for k, p in WEAK.items()
)
_ROLE = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{r}'" for k, r in ROLES.items()) + " END"
_RANK = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
_NEEDED = " OR ".join(f"(kind = '{k}' AND " + " AND ".join(f"list_contains(roles, '{r}')" for r in v) + ")" for k, v in NEEDS.items())

#: DuckDB SQL of ``find_secrets`` on documents.
ORACLE_SQL = f"""
WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents),
base AS MATERIALIZED (SELECT doc, kind, s::BIGINT AS s, (s + n)::BIGINT AS e FROM ({_FOUND})),
candidates AS MATERIALIZED (SELECT doc, kind, s::BIGINT AS s, (s + n)::BIGINT AS e FROM ({_CANDIDATES})),
weak AS (SELECT * FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc = c.doc AND b.s < c.e AND c.s < b.e)),
parts AS MATERIALIZED (
 SELECT p.doc, kind, s, e, {_ROLE} AS role, len(regexp_extract_all(left(text, s::INTEGER), '\\n[ \\t\\r]*\\n')) AS scope
 FROM (SELECT * FROM base UNION ALL SELECT * FROM weak) p JOIN texts t ON t.doc = p.doc),
linked AS (
 SELECT doc, kind, s, e FROM (
  SELECT w.doc, w.kind, w.s, w.e, list(DISTINCT p.role) AS roles FROM parts w JOIN parts p
  ON p.doc = w.doc AND p.scope = w.scope AND p.e > w.s - {WINDOW} AND p.s < w.e + {WINDOW}
  WHERE w.kind IN ({", ".join(f"'{k}'" for k in NEEDS)}) GROUP BY ALL) WHERE {_NEEDED}),
strong AS (SELECT doc, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
 string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, {_RANK}) AS spans FROM base GROUP BY doc),
every AS (SELECT doc, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, {_RANK}) AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM linked) GROUP BY doc)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
 sha256(coalesce(strong.spans, '')) AS base_sha256, coalesce(every.spans, '') AS spans
FROM texts LEFT JOIN strong USING (doc) LEFT JOIN every USING (doc)
"""
