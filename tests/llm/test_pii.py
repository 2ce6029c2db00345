import hashlib
import re

import regex

from cairn.llm import pii

from .conftest import words

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(d):
    s = [int(c) for c in reversed(d)]
    return (sum(s[::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0


def plain(text):
    text, out = text or "", []
    for k, (name, pattern) in enumerate([("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)]):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if name == "ip" and any(int(x) > 255 for x in m[0].split(".")) or name == "card" and not (12 <= len(d) <= 19 and luhn(d)) or name == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end(), name))
    return ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(out)), [sum(x[1] == k for x in out) for k in range(4)]


PARTS = ["a.b@c.de", "x@y", "_z%+-@q-1.r.s_t@u.v", "é@é.com", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "000255.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+49.30", "++4930 1234567", "日本 4532015112830366.", "@", "..", "+", "- ", "12 34 56", "😀", "\n", "4111111111111111@h.io", "+41111111111111111", "a@b.c@d.e", "99999999999999999999"]


def test_base_spans(docs, rng):
    texts = ["".join(rng.choice(PARTS + [" ", " the ", "0"]) for _ in range(rng.randrange(12))) for _ in range(400)] + [None, "", "7 " * 20000, "x" * 4000, "1.1.1.1 " * 700, "a" * 5000 + "@b.c"]
    rows = list(enumerate(texts)) + [(None, PARTS[0]), (0, texts[0])]
    got = pii.extracted(docs(rows, extra=True)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), *plain(t)[1], hashlib.sha256(plain(t)[0].encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    for r in got:
        mine = [s for s in r.spans.split(",") if s and not s.startswith("id:")]
        assert r.doc_id in (None, 0) or ",".join(mine) == plain(texts[r.doc_id])[0]


def test_contexts_find_unseen_identifiers(docs, rng):
    seeded = [(i, f"{words(rng, 5)} my account number {'4111 1111 1111 1111' if i % 2 else f'10.0.{i}.7'} was charged {words(rng, 5)}") for i in range(30)]
    hidden = [(100, "my account number ZX-99118273 was charged"), (101, "some other code ZX-99118274 was seen"), (102, "see build 2024010112 here")]
    cards = [(200 + i, f"my account number {n} was charged") for i, n in enumerate(["user7@host.org", "u8@host.org", "u9@host.org"])]
    got = {r.doc_id: r.spans for r in pii.extracted(docs(seeded + hidden + cards)).collect()}
    assert got[100] == "id:18:29" and got[101] == "" and got[102] == ""


def plain_units(text):
    return regex.findall(r"[\p{L}\p{N}_]++|[^\s\p{L}\p{N}_]", text.lower())


def plain_patterns(text, start, end):
    w, right = plain_units(text[:start][-64:]), plain_units(text[end:][:64])
    k = bool(w) and not regex.match(r"[\p{L}\p{N}_]", w[-1])
    out = ["L " + " ".join(w[-2 - k :])] if len(w) >= 2 + k else []
    return out + (["A " + " ".join(w[-1 - k :]) + " _ " + right[0]] if len(w) >= 1 + k and right else [])


def plain_bootstrap(rows):
    """All spans of each row: the graph's scores are worked out again from nothing in each round."""
    seen, graph = [], {}
    for n, (_, text) in enumerate(rows):
        text = text or ""
        base = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in plain(text)[0].split(",") if x)]
        free = [("id", *m.span()) for m in regex.finditer(pii.CANDIDATE, text)]
        free = [c for c in free if not any(b[1] < c[2] and c[1] < b[2] for b in base)]
        for kind, a, b in base + free:
            for p in plain_patterns(text, a, b):
                e = graph.setdefault(p, {}).setdefault(text[a:b], [False, False])
                e[0] |= kind != "id" or bool(regex.match(pii.KEY, text[a:b]))
                e[1] |= kind == "id"
        seen.append((base, free))
    sure = set()
    while True:
        conf = {}
        for p, words_ in graph.items():
            good = sum(e[0] or w in sure for w, e in words_.items())
            if good >= pii.PATTERN_SUPPORT and good / (len(words_) + 1) >= pii.PATTERN_SHARE:
                conf[p] = good / (len(words_) + 1)
        doubt = {}
        for p, c in conf.items():
            for w, e in graph[p].items():
                if e[1]:
                    doubt[w] = doubt.get(w, 1) * max(1 - c, 1e-6)
        new = {w for w, d in doubt.items() if 1 - d >= pii.SURE}
        if len(new) <= len(sure):
            break
        sure = new
    order = ["email", "ip", "card", "phone", "id"]
    out = []
    for (base, free), (_, text) in zip(seen, rows):
        spans = base + [c for c in free if (text or "")[c[1] : c[2]] in sure]
        out.append(",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order.index(s[0])))))
    return out


def test_bootstrapping_agrees_with_a_plain_one(docs, rng):
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 1)) + "a"
    frames = ['token = "{}"', "token='{}'", "TOKEN: {} end", "my account number {} was", "staff no. {}", "see {} here", "{}", "of the {} and"]
    slots = [lambda: hexed(40), lambda: hexed(32).upper(), lambda: f"AB-{rng.randrange(1000, 9999)}", lambda: f"{rng.randrange(10**9)}", lambda: f"12 345 {rng.randrange(100, 999)}", lambda: f"10.0.{rng.randrange(255)}.7", lambda: f"u{rng.randrange(99)}@host.org", lambda: "4111 1111 1111 1111"]
    rows = []
    for i in range(260):
        parts = [words(rng, rng.randrange(4))]
        for _ in range(rng.randrange(4)):
            frame = rng.choice(frames)
            slot = slots[rng.choice([0, 0, 0, 0, 1, 2] if "oken" in frame.lower() else range(8))]
            parts += [frame.format(slot()), words(rng, rng.randrange(3))]
        rows.append((i, " ".join(parts)))
    rows += [(900, None), (901, ""), (902, "12345"), (903, "1111.2222.3333@x.y 1.2.3.4.5.6.7.8 99 1234"), (904, "a1234_" * 300 + "@x.y"), (905, rows[0][1]), (905, rows[0][1])]
    got = sorted((r.doc_id, r.spans) for r in pii.extracted(docs(rows, extra=True)).collect())
    want = sorted((i, s) for (i, _), s in zip(rows, plain_bootstrap(rows)))
    assert got == want
    found = sum(s.count("id:") for _, s in want)
    assert found > 50 and found < sum(len(regex.findall(pii.CANDIDATE, t or "")) for _, t in rows)


def test_secrets_are_found_where_clean_numbers_stay():
    import duckdb

    path = "/root/testdata/sf0.01/documents.parquet"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{path}'").fetchall()
    spans = dict(zip([i for i, _ in rows], plain_bootstrap(rows)))
    secret = {i for i, t in rows if re.search(r'(?i)token = "[0-9a-f]{40}"', t or "")}
    with_id = {i for i, s in spans.items() if "id:" in s}
    assert secret and len(secret & with_id) >= 0.9 * len(secret) and not with_id - secret


def test_redaction(docs):
    pad = "é" * 5000
    rows = [(1, "mail a.b@c.de or +1 (743) 555-3824, ip 1.2.3.4!"), (2, "nothing"), (3, None), (4, pad + " a.b@c.de " + pad), (5, "4111111111111111@h.io x")]
    df = docs(rows, extra=True)
    out = pii.redacted(df)
    assert out.columns == df.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got[1][0] == "mail [EMAIL] or [PHONE], ip [IP]!" and got[2] == ("nothing", 7) and got[3] == (None, None)
    assert got[4][0] == pad + " [EMAIL] " + pad and got[4][1] == len(got[4][0]) and got[5][0] == "[EMAIL] x"


def test_columns_of_any_name_are_kept(docs):
    from pyspark.sql import functions as F

    df = docs([(1, "mail a.b@c.de now")]).withColumns({c: F.lit(c) for c in ("key", "key_", "added", "ADDED_", "changed", "base", "others", "spans")})
    (row,) = pii.redacted(df).collect()
    assert pii.redacted(df).columns == df.columns and (row.text, row.key, row.added, row.changed) == ("mail [EMAIL] now", "key", "added", "changed")


def test_long_texts_are_redacted(docs):
    long = "né a.b@c.de 1.2.3.4 " * 6000
    (row,) = pii.redacted(docs([(1, long)])).collect()
    assert row.text == "né [EMAIL] [IP] " * 6000 and row.n_chars == len(row.text)


def test_empty(docs):
    assert pii.extracted(docs([])).count() == 0 and pii.redacted(docs([])).count() == 0
