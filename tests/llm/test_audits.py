"""Source divergence, page text and conversation repair against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldlake.llm import divergence, extract, repair

CLASH = ("term", "n", "docs", "id", "tile", "block", "total", "row", "host", "path", "tokens", "shared", "fate", "gone", "name", "turn_", "value", "rank")


def wide(spark, rows, schema):
    return spark.createDataFrame(rows, schema).select("*", *[F.lit(1).alias(c) for c in CLASH])


# -- divergence

DOCS = [
    (1, "Alpha beta Beta ÉTÉ", "en", "a"), (2, "alpha beta", "en", "b"), (3, "alpha, beta; gamma7delta", "en", "b"), (4, None, "en", "c"), (5, "", "en", None),
    (6, "alpha " * 5000 + "beta", "en", "a"), (7, "uno dos", None, "a"), (7, "uno dos", None, "a"), (None, "uno", None, "x"), (8, "nur einmal", "de", "z"),
    (9, "日本 日本 alpha", "en", "日"), (10, "alpha beta", "en", "e"), (11, "alpha beta", "en", "f"),
]
DOCS_SCHEMA = "doc_id long, text string, lang string, source string"


def divergence_by_hand(rows, least, top):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: {t: c[t] for t in kept} for (l, s), c in groups.items() if l == lang}
        own[None] = {t: sum(c[t] for c in own.values()) for t in kept}
        p = {s: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept} for s, c in own.items()}
        for s in own.keys() - {None}:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own.keys() - {None, s}]
            term = [(p[s][t] - p[None][t], t) for t in kept if own[s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, i, v, k + 1) for k, (v, i) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("least,top,block", [(1, 50, 65_536), (2, 1, 2), (99, 50, 65_536)])
def test_divergence(spark, monkeypatch, least, top, block):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    got = divergence.divergence(wide(spark, DOCS, DOCS_SCHEMA), least, top).collect()
    assert sorted(tuple(r) for r in got) == divergence_by_hand(DOCS, least, top)


def test_divergence_sql(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = db.sql(f"SELECT lang, source, part, item, value, rank FROM ({divergence.ORACLE})").fetchall()
    assert sorted(tuple(r) for r in divergence.divergence(docs).collect()) == sorted(want)


def test_divergence_edges(spark, monkeypatch):
    assert divergence.divergence(wide(spark, DOCS, DOCS_SCHEMA).limit(0)).count() == 0
    assert divergence.divergence(wide(spark, DOCS[:1], DOCS_SCHEMA), 1).where("part = 'pair'").count() == 0
    monkeypatch.setattr(divergence, "HELD", 1)  # sums are handed on after every document
    got = divergence.term_counts(wide(spark, DOCS, DOCS_SCHEMA)).where("lang = 'en' and source = 'a'").collect()
    assert {r["term"]: (r["n"], r["docs"]) for r in got} == {"": (0, 2), "alpha": (5001, 2), "beta": (3, 2), "ÉtÉ": (1, 1)}


def test_shares_are_exact():
    rng = random.Random(3)
    for _ in range(200):
        total = rng.randint(5, 9 * 10**15)
        n = rng.randint(0, total - 5)
        assert divergence.share(divergence.np.array([n]), total)[0] == 1 + 10**9 * (n + 5) // total


def test_gallop_and_merge():
    rng = random.Random(4)
    np = divergence.np
    for _ in range(100):
        a, b = (np.array(sorted(rng.sample(range(400), rng.randint(0, 150))), np.int64) for _ in range(2))
        place = divergence.gallop(a, b, rng.choice([1, 3, 512]))
        assert [int(b[k]) if k >= 0 else None for k in place] == [x if x in set(b.tolist()) else None for x in a.tolist()]
        n, m = rng.randint(2000, 9000), rng.randint(2000, 9000)
        p, q = ({int(t): 1 + 10**9 * (t % 7 + 1 + 5) // total for t in ids} for ids, total in ((a, n), (b, m)))
        want = sum(abs(p.get(t, 1 + 10**9 * 5 // n) - q.get(t, 1 + 10**9 * 5 // m)) for t in p.keys() | q.keys())
        assert divergence.merge((a, a % 7 + 1, n), (b, b % 7 + 1, m)) == (want, len(p.keys() | q.keys()))


# -- page text

PROSE = [f"Sentence number {k} of the story tells how the river rose and why the bridge was closed that spring." for k in range(9)]


def page(k, *body):
    menu = "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in ("Home", "News", "About us"))
    return f"""<!DOCTYPE html><html><head><title>T {k}</title><style>p > b {{x:1}}</style><script>if (a < b) document.write("<p>no</p>");</script></head>
<body class="has-sidebar"><header id="top"><h2>Site</h2></header><nav><ul>{menu}</ul></nav><div class="cookie-notice">We use cookies.</div>{"".join(body)}
<aside><p>Most read</p></aside><form><p>Your mail <input name=m> <button>Go</button></p></form><footer>&copy; 2024 {k}</footer></body></html>"""


def article(*blocks):
    return "<article class='post'><header><h1>Head &amp; line</h1></header>" + "".join(f"<p>{b}" for b in blocks) + "<div class=\"userComments\"><p>first!!</p></div></article>"


def test_markup():
    assert extract.lines("<div class=x>a<b>b</b>c &amp;&#33;<br>d</div>") == [("abc &! d", extract.OPEN, "/div.x", False)]
    kinds = {t: k for t, k, _, _ in extract.lines(page(1, article(PROSE[0])))}
    assert kinds[PROSE[0]] == kinds["Head & line"] == extract.ARTICLE
    assert all(kinds[t] == extract.FURNISHED for t in ("Site", "Home", "We use cookies.", "Most read", "© 2024 1", "first!!"))
    assert not {"no", "Go", "T 1"} & set(kinds) - {"Go"}
    wrapped = {t: k for t, k, _, _ in extract.lines("<div class='page-with-sidebar noAds'><div class='banner-top'><main><p>a</main></div><p>b<p class='adSlot'>c</div>")}
    assert wrapped == {"a": extract.ARTICLE, "b": extract.OPEN, "c": extract.FURNISHED}
    for broken in ("", "<", "<p", "<p title=\"a>b", "a<!-- b", "</div></p>x", "<script>x", "<a href='x>y</a>z", "&#xD800; &am", "<p>" * 3000 + "x", "\x00<b>", "<article>"):
        assert isinstance(extract.lines(broken), list)
    assert [t for t, *_ in extract.lines("a < b <p title='1 > 0'>c")] == ["a < b", "c"]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = extract.common(a, b)
        assert len(got) == table[-1][-1] and all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))


def texts(spark, rows):
    got = extract.extract(wide(spark, rows, "page_id long, url string, html string")).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    return Counter((r["page_id"], r["text"]) for r in got)


def test_article_pages(spark):
    rows = [(k, f"https://h.example/en/{k}?x=1", page(k, article(PROSE[k], "shared &lt;passage&gt; of all  pages"))) for k in range(4)]
    rows += [(None, None, None), (5, "no url", ""), (6, "https://alone.example/", page(6, article(PROSE[6]))), rows[0]]
    rows += [(7, "https://h.example/en/7", page(7, article(*["a long text "] * 4000)))]
    want = Counter({(k, f"Head & line {PROSE[k]} shared <passage> of all pages"): 1 + (k == 0) for k in range(4)})
    want += Counter({(None, ""): 1, (5, ""): 1, (6, f"Head & line {PROSE[6]}"): 1, (7, "Head & line " + " ".join(["a long text"] * 4000)): 1})
    assert texts(spark, rows) == want
    assert extract.extract(wide(spark, rows, "page_id long, url string, html string").limit(0)).count() == 0


def test_pages_without_article_differ_from_their_neighbours(spark):
    def plain(k):
        return page(k, "<div class=w1><p>All about rivers since 1990</p></div>", f"<div class=w2><h1>Day {k}</h1><p>{PROSE[k]}</p><p>{PROSE[k + 1][::-1]}</p></div>", "<div class=w3><p>Printed with care</p></div>")

    rows = [(k, f"https://h.example/en/{k}", plain(k)) for k in range(6)]
    copy = (9, "https://h.example/en/1/", plain(1))  # next to the page it copies: both keep their text
    got = dict(texts(spark, [*rows, copy]).keys())
    assert {k: got[k] for k in range(6)} == {k: f"Day {k} {PROSE[k]} {PROSE[k + 1][::-1]}" for k in range(6)}
    assert PROSE[1] in got[9]
    alone = dict(texts(spark, [(1, "https://solo.example/a", plain(1))]).keys())
    assert PROSE[1] in alone[1] and "Printed with care" in alone[1] and "cookies" not in alone[1]


def test_neighbours_over_all_ranges(spark):
    rows = [(k, f"https://{'big' if k % 3 else 'x%d' % k}.example/p{k:03}", f"<p>{k}") for k in range(60)]
    parsed = extract._parsed(spark.createDataFrame(rows, "page_id long, url string, html string"))
    ids = {r["row"]: r["page_id"] for r in parsed.select("row", "page_id").collect()}
    got = sorted((ids[r["row"]], ids[r["next_row"]]) for r in extract._neighbours(parsed).collect())
    big = [k for k in range(60) if k % 3]
    assert got == list(zip(big, big[1:], strict=False))


# -- conversation repair


def damage_by_hand(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role, text = "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out[conv] += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, x in out.items()}


def repair_by_hand(rows):
    """Every audit that could be cheapest, one by one."""
    seen, faults = set(), []
    for _, role, text in rows:
        said = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    stack = [(0, "", [], 0)]
    while stack:
        i, audit, out, cost = stack.pop()
        initials = "".join(r[:1] or "?" for r, _ in out)
        if cost > 3 * len(rows) or not re.fullmatch(r"s?(ua)*u?", initials):
            continue
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", initials):
            found = cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
            best = min(best or found, found)
        stack += [(i, audit + "I", [*out, (r, "")], cost + 2) for r in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            stack.append((i + 1, audit + "D", out, cost + 3))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                stack.append((i + 1, audit + "K", [*out, (role, text)], cost + extra))
                stack += [(i + 1, audit + "R", [*out, (r, text)], cost + 2 + extra) for r in ("user", "assistant")]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), *best)


def random_rows(rng, n):
    said = ["a.", "b?", "c", "", " ", "d!\n", "日本."]
    return [(rng.choice([None, 0, 1, 2, 3, 7]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), rng.choice(said)) for _ in range(n)]


@pytest.mark.parametrize("modulus", [repair._MODULUS, 5])
def test_repair_against_all_audits(monkeypatch, modulus):
    monkeypatch.setattr(repair, "_MODULUS", modulus)  # with 5 nearly all hashes collide
    rng = random.Random(modulus)
    for _ in range(250):
        rows = sorted(random_rows(rng, rng.randint(0, 4)), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        conversation = repair.Repair()
        for row in rows:
            conversation.add(*row)
        assert conversation.result() == repair_by_hand(rows)


def test_audits_compare_as_strings():
    rng = random.Random(2)
    root = repair.Node(None, "")
    nodes = [root]
    for _ in range(400):
        nodes.append(repair.Node(rng.choice(nodes[-40:]), rng.choice("DK")))
    for _ in range(3000):
        a, b = rng.choice(nodes), rng.choice(nodes)
        assert repair.earlier(a, b) == (a.letters() < b.letters())
        k = rng.randint(0, a.length)
        assert a.first(k).letters() == a.letters()[:k]


def test_repair_rows(spark):
    rng = random.Random(9)
    rows = [(c, *r) for c in [*range(60), None] for r in random_rows(rng, rng.randint(1, 4))]
    rows += [(100, k, "user" if k % 2 else "assistant", f"turn {k}. " * 50) for k in range(300)] + [(101, 1, None, None), (101, None, None, "x."), rows[0]]
    got = repair.repaired_conversations(wide(spark, rows, "conv_id long, turn long, role string, text string").repartition(7)).collect()
    by_hand = damage_by_hand(rows)
    assert len(got) == len(by_hand) == len({r[0] for r in rows})
    for r in got:
        if r["conv_id"] != 100:
            assert tuple(r)[1:] == repair_by_hand(by_hand[r["conv_id"]]), r
    assert repair.repaired_conversations(wide(spark, rows, "conv_id long, turn long, role string, text string").limit(0)).count() == 0


def test_dropped_conversation(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = repair.repaired_conversations(wide(spark, [(gone, 0, "user", "x.")], "conv_id long, turn long, role string, text string")).first()
    assert tuple(got) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_secret_model_learns_from_all_documents(spark):
    from pyspark.sql import functions as F

    from fieldlake.llm import secrets

    rare = [a + "qz" for a in "abcdefghijklmnop"]  # one document each, of more than any sample took
    text = F.coalesce(F.get(F.array(*map(F.lit, rare)), F.col("id").cast("int")), F.lit("ttt"))
    rows = spark.range(60_000, numPartitions=4).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("s").alias("source"))
    known = secrets.fit(rows).known
    assert all(known[(ord(t[0]) - 97) * 676 + (ord(t[1]) - 97) * 26 + ord(t[2]) - 97] for t in rare) and known.sum() == len(rare) + 1
    # 45,000 findings that are clear negatives and two secrets: all are learned, once each
    learned = []
    fit = secrets.RandomForestClassifier.fit
    secrets.RandomForestClassifier.fit = lambda self, df, *a: (learned.append(dict(map(tuple, df.groupBy("label").count().collect()))), fit(self, df, *a))[1]
    try:
        many = spark.range(45_000, numPartitions=4).select(F.col("id").alias("doc_id"), F.concat(F.lit("commit "), F.sha1(F.col("id").cast("string"))).alias("text"), F.lit("s").alias("source"))
        two = spark.createDataFrame([(-1, "AKIA" + "Q7" * 8, "s"), (-2, "AKIA" + "R7" * 8, "s"), (-2, "AKIA" + "R7" * 8, "s")], many.schema)
        secrets.fit(many.unionByName(two))
    finally:
        secrets.RandomForestClassifier.fit = fit
    assert learned == [{0.0: 45_000, 1.0: 2}]
