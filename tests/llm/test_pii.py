import hashlib
import re

from helpers import awkward, documents

from tidemark.llm import pii, queries

DATA = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


HARD = [
    "a@b.c+d@e.f", "a@b@c.d", "x@y.z.@d.e q", "1.2.3.4.5.6.7.8", "300.1.1.1 001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111 5", "+1 (2) 3-4.5 67890", "+12",
    "🙂 a@b.cc 🙂+44 20 7946 0958", "9" * 30000, "1.2.3." * 3000 + "4", "a" * 50000 + "@", "@" * 1000, "a.b@c-d.e--f..g@h.i", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 " * 300, "a@b.c_d@e.f %@-.-",
]


def test_base_spans_match_the_patterns(spark):
    rows = [*awkward(), *[(100 + i, t) for i, t in enumerate(HARD)]]
    got = pii.summary(pii.find(documents(spark, rows))).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), hashlib.sha256(base(t).encode()).hexdigest()) for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in got) == want


def test_query_keeps_base_spans(spark):
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, DATA, "documents").collect()}
    for r in queries.op1_pii(spark, DATA).collect():
        assert r["base_sha256"] == hashlib.sha256(base(texts[r["doc_id"]]).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert len(spans) == r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] + r["n_added"]


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"lorem phone: +1 (555) 010-{2000 + i} thanks, ipsum") for i in range(20)]
    rows += [(50, "dolor phone: 555-010-7788 thanks, amet"), (51, "order number 555-010-7788 shipped")]
    got = {r["doc_id"]: (r["n_phone"], r["spans"]) for r in pii.summary(pii.find(documents(spark, rows))).collect()}
    assert got[50] == (0, "phone:13:25")
    assert got[51] == (0, "")
    clean = {r["doc_id"]: r["text"] for r in pii.redact(pii.find(documents(spark, rows))).collect()}
    assert clean[50] == "dolor phone: [PHONE] thanks, amet" and clean[51] == rows[21][1]


def plain_added(rows, confidence=0.6, least=3):
    """Added phone spans of texts with numbers as single words: patterns and beliefs by plain loops, until no pattern is new."""
    edges, places = {}, []
    for i, t in rows:
        for m in re.finditer(r"(?<![+0-9-])[0-9]+-[0-9-]*[0-9]|\+[0-9][0-9-]+", t):
            v, seed = re.sub("[^0-9]", "", m[0]), m[0].startswith("+")
            left, right = t[: m.start()].split()[-1:], t[m.end() :].split()[:1]
            for side, word in [("l", w) for w in left] + [("r", w) for w in right]:
                word = re.sub("[0-9]", "0", word.lower())
                edges[(side, word, v)] = edges.get((side, word, v), False) or seed
                if not seed:
                    places.append((i, m.start(), m.end(), side, word))
    sure, belief = {}, {}
    while True:
        score, believed = {}, {}
        for (side, word, v), seed in edges.items():
            b = 1.0 if seed else belief.get(v, 0.0)
            total, n, k = score.get((side, word), (0.0, 0, 0))
            score[(side, word)] = total + b, n + 1, k + (b > 0)
        new = {p: t / (n + 2) for p, (t, n, k) in score.items() if t / (n + 2) >= confidence and k >= least}
        settled = len(new) == len(sure) and sum(new.values()) - sum(sure.values()) <= 1e-3
        sure, doubt = new, {}
        if settled:
            break
        for (side, word, v), seed in edges.items():
            if not seed and (side, word) in sure:
                doubt[v] = doubt.get(v, 1.0) * (1 - min(sure[(side, word)], 0.999))
        belief = {v: 1 - d for v, d in doubt.items()}
    return {(i, a, b) for i, a, b, side, word in places if (side, word) in sure}


def test_bootstrapping_goes_several_hops(spark):
    """Seeds teach `call`; numbers found beside it teach `dial`, of which no seed is; those beside it teach `ring`."""
    rows = [(i, f"lorem call +1-555-010-{2000 + i} ipsum{i}") for i in range(40)]
    rows += [(100 + i, f"a{i} call 555-010-{3000 + i} b{i}") for i in range(20)] + [(200 + i, f"c{i} dial 555-010-{3000 + i} d{i}") for i in range(20)]
    rows += [(300 + i, f"e{i} dial 555-010-{4000 + i} f{i}") for i in range(4)] + [(400 + i, f"g{i} part 555-010-{5000 + i} h{i}") for i in range(20)]
    found = {r["doc_id"]: r["spans"] for r in pii.summary(pii.find(documents(spark, rows))).collect()}
    want = plain_added(rows)
    got = {(i, *map(int, x.split(":")[1:])) for i, t in found.items() if i >= 100 and t for x in t.split(",")}
    assert got == want and {i for i, *_ in want} == {*range(100, 120), *range(200, 220), *range(300, 304)}
    assert len({i for i, *_ in plain_added(rows[:60])}) == 20  # the first hop alone


def test_many_matches_in_one_text(spark):
    many = "a@b.cc " * 3000
    docs = documents(spark, [(1, many)])
    got = pii.summary(pii.find(docs)).first()
    assert got["n_email"] == 3000 and got["base_sha256"] == hashlib.sha256(base(many).encode()).hexdigest()
    assert pii.redact(pii.find(docs)).first()["text"] == "[EMAIL] " * 3000


def test_redaction_keeps_rows_and_columns(spark):
    docs = documents(spark, [*awkward(), (9, "🙂 a@b.cc 🙂+44 20 7946 0958, 4111 1111 1111 1111")])
    got = pii.redact(pii.find(docs))
    assert got.columns == docs.columns and got.count() == docs.count()
    assert got.where("doc_id = 9").first()["text"] == "🙂 [EMAIL] 🙂[PHONE], [CARD]"
    assert pii.redact(pii.find(docs.limit(0))).count() == 0
