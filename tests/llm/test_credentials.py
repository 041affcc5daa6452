"""Linked credentials against a search over all pairs of parts, and against SQL."""

import hashlib
import random
import re

from compare import connect, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallowgrid.llm import credentials as c

VALUE = "Ab3dEf6hIj9kLm2nOp5qRs8t"
PIECES = ["token = \"f3ef4d6b2755a36d7d9c25bd72c4d5f6\"", "AKIA" + "B7" * 9, "user: anna.b", "client_id='web-7'", VALUE, "https://db.example.com:8443/x", "\n\n", "\n \t\n", "\n", " plain words ", "password: abc", "PASSWD=hunter22", "ſecret: abcdefgh", "ab" * 13, "x" * 190, "é" * 40, " ", "'", "secret: api key=abcdefgh"]


def by_pairs(text, window=c.WINDOW):
    """Spans, straight from the rules: every part against every other."""
    text = text or ""
    strong = []
    for kind, pattern, group, least in (
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]+", 0, 24),
    ):
        strong += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    weak = [
        (m.start(), m.end(), k)
        for k, p in c.WEAK.items()
        for m in p.finditer(text)
        if (k != "value" or all(any(f(ch) for ch in m[0]) for f in (str.isupper, str.islower, str.isdigit))) and not any(s < m.end() and m.start() < e for s, e, _ in strong)
    ]
    scope = lambda at: len(re.findall(r"\n[ \t\r]*\n", text[:at]))
    order = lambda x: (x[0], c.KINDS.index(x[2]))
    out = list(strong)
    for s, e, k in weak:
        near = {c.ROLES[k2] for s2, e2, k2 in strong + weak if scope(s2) == scope(s) and e2 > s - window and s2 < e + window}
        if set(c.NEEDS[k]) <= near:
            out.append((s, e, k))
    show = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=order))
    counts = [sum(k == n for _, _, k in strong) for n in c.STRONG]
    return (*counts, hashlib.sha256(show(strong).encode()).hexdigest(), show(out))


def found(docs):
    return [tuple(r) for r in c.find_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans").collect()]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14), min_size=1, max_size=25))
def test_links_are_those_of_all_pairs(make_docs, texts):
    docs = [(k, "".join(t)) for k, t in enumerate(texts)]
    assert sorted(found(make_docs(docs))) == sorted((k, *by_pairs(t)) for k, t in docs)


def test_sql_finds_the_same(spark, make_docs, small_dir):
    rng = random.Random(3)
    docs = [(k, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 18)))) for k in range(150)]
    con = connect(small_dir)
    arrow = make_docs(docs, extra=False).toArrow()
    con.register("given_docs", arrow)
    con.sql("CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM given_docs")
    got = rows(c.find_secrets(make_docs(docs)).toArrow())
    assert got == rows(con.sql(c.ORACLE_SQL).to_arrow_table())
    assert any(re.search("(ident|value|endpoint):", str(r)) for r in got[1])


def test_weak_parts_need_their_complements(make_docs):
    texts = [f"{VALUE}", "user: anna", "https://db.example.com", f"user: anna {VALUE}", f"user: anna\n\n{VALUE}", f"user: anna {'w ' * 120}{VALUE}", f"user: anna {VALUE} https://db.example.com", f"https://db.example.com {VALUE}"]
    got = {k: s for k, *_, s in found(make_docs(list(enumerate(texts))))}
    assert [got[k] for k in (0, 1, 2, 4, 5, 7)] == [""] * 6
    assert got[3] == "ident:0:10,value:11:35" and got[6] == "ident:0:10,value:11:35,endpoint:36:58"


def test_odd_texts(spark, make_docs):
    long = ("user: anna " + VALUE + " ") * 4000 + "\n\n" + VALUE
    docs = [(None, None), (None, ""), (1, None), (2, "token=abcdef user: anna"), (2, "token=abcdef user: anna"), (None, "token=abcdef user: anna"), (3, long), (4, "A1b" * 100_000), (5, "A1b" * 50_000 + " user: anna")]
    got = found(make_docs(docs))
    none = ("", 0)
    assert len(got) == len(docs) and none
    for k, t in docs:
        if t is None or len(t) < 1000:
            assert (k, *by_pairs(t)) in got
    spans = {k: s for k, *_, s in got}
    assert spans[3].count("ident") == spans[3].count("value") == 4000 and spans[4] == "" and spans[5].startswith("value:0:150000,ident")
    assert found(make_docs(docs).limit(0)) == []
