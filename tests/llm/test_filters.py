"""URL filters, secret scan, decontamination and token attribution against plain versions."""

import hashlib
import random
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from logsig.llm import attribution, bpe, decontaminate, secretscan, urlfilter
from logsig.llm.queries import URL_RULES, contaminated

from .conftest import ODD

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def judge(url, rules):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [
        (-len(h + p), v != "block", h + p, v)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return (host, path, min(fits)[2], min(fits)[3]) if fits else (host, path, None, "allow")


def test_url_filter(spark, monkeypatch):
    urls = [None, "", "no scheme.org/", "http://", "http:///x", "://org/", "HTTP://WWW.Example.ORG/es/1?x#y"]
    urls += ["https://a.b.org", "https://org?/fr/", "http://example.org/en/12", "http://notexample.org/es/"]
    urls += ["http://x.com/fr/#a", "http://com/de/", "http://.com/de/", "http://a..com/fr", "http://É.COM/FR/"]
    urls += ["http://u@x.com:80/de/", "http://x.com/de/" + "p" * 50_000, "http://x.com/fr/://y.org/", *["http://x.com/de/1"] * 40]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("rule", F.lit(1))
    rules = [*URL_RULES, ("example.org", "/en/1", "allow"), ("x.com", "", "allow"), (None, "/", "block"), ("COM", "/de/", "block")]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    plain = [r for r in rules if r[0]] + [("com", "/de/", "block")]
    for bound in (urlfilter.BROADCAST_RULES, 0):
        monkeypatch.setattr(urlfilter, "BROADCAST_RULES", bound)
        got = urlfilter.judged(pages, "url", table).collect()
        assert len(got) == len(urls)
        for r in got:
            assert (r.host, r.path, r.rule, r.verdict) == judge(r.url, plain)
        none = urlfilter.judged(pages, "url", table.limit(0)).collect()
        assert {(r.rule, r.verdict) for r in none} == {(None, "allow")}
    assert urlfilter.judged(pages.limit(0), "url", table).count() == 0


KEY = "Zq9xYb7TnM2LwEr5UoPi8K"


def test_secret_candidates():
    text = f"é PASSWORD : 'abcdefghijkl' token=short AKIA{'A' * 14} AKIA1 {'0f' * 8} {KEY}"
    got = [(secretscan.KINDS[k], text[s:e], text[v:e]) for s, k, e, v, _ in secretscan.candidates(text)]
    assert got == [
        ("assign", "PASSWORD : 'abcdefghijkl", "abcdefghijkl"),
        ("access", "AKIA" + "A" * 14, "AKIA" + "A" * 14),
        ("hex", "0f" * 8, "0f" * 8),
        ("bare", KEY, KEY),
    ]
    # A failing match uses up its text; a long s is not an s.
    assert secretscan.candidates("password=secret = abcdefghijklmno") == []
    assert secretscan.candidates("paſſword=abcdefghijklmno") == []
    assert secretscan.candidates("deadbeef" * 2000)[0][:3] == (0, 2, 16000)


def plain_base(text):
    spans = []
    patterns = [
        (r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("AKIA[A-Z0-9]+", 0, 18),
        ("[0-9a-f]+", 0, 16),
    ]
    for kind, (pattern, group, least) in enumerate(patterns):
        spans += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(spans)


def test_secret_scan(spark, make):
    draw = random.Random(2)
    parts = ["token=", "secret : '", "AKIA", "api_key", "=", "abcdef0123456789", "ABCDEFGH12345678", " ", "é", "\n", KEY, "passwd"]
    texts = [*ODD] + ["".join(draw.choice(parts) for _ in range(draw.randrange(30))) for _ in range(150)]
    texts += [f"copied {KEY}", f"own {KEY[::-1]}", "token='0123456789abcdef0123'"]
    rows = [(i, t, "en", f"s{i % 8}", 0) for i, t in enumerate(texts)]
    rows += [(900 + i, f"copied {KEY}", "en", None if i == 9 else f"s{i}", 0) for i in range(10)]
    rows += [(999, "token='aaaaaaaaaaaaaaaa'", None, None, None)] * 2
    docs = make(rows).withColumn("candidates", F.lit(1)).withColumn("owner", F.lit(2))
    got = secretscan.scanned(docs, "doc_id").select("*", secretscan.spans_text().alias("spans")).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r[1] or "" for r in rows}
    for r in got:
        base = plain_base(by_id[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in base) for n in range(3)]
        joined = ",".join(f"{secretscan.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
    spans = {r.doc_id: r.spans for r in got}
    assert "bare" not in spans[900]  # ten owners: an example
    assert spans[len(texts) - 2] == f"bare:4:{4 + len(KEY)}"  # one owner: live
    red = {r.doc_id: r.text for r in secretscan.redacted(docs, "text", "#").collect()}
    assert red[999] == "token='#'" and red[900] == f"copied {KEY}" and red[len(texts) - 2] == "own #"
    assert all(red[r[0]] == r[1] for r in rows if not spans[r[0]])
    assert secretscan.scanned(docs.limit(0), "doc_id").count() == 0
    assert secretscan.redacted(docs.limit(0)).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def test_contamination(spark, make, tmp_path, monkeypatch):
    draw = random.Random(4)
    vocabulary = ["the", "of", "a"] * 4 + ["".join(draw.choice("abcé1") for _ in range(4)) for _ in range(60)]
    some = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(draw.choice([3, 12, 13, 14, 40])))) for i in range(30)]
    items += [(30, None), (31, ""), (32, "..."), (33, "the of a"), (34, "lone-word"), (5, items[6][1]), (None, "of the of")]
    texts = [*ODD]
    for _ in range(120):
        parts = []
        for _ in range(draw.randrange(5)):
            parts += some(draw.randrange(40))
            own = plain_words(draw.choice(items)[1])
            if own:
                a = draw.randrange(len(own))
                parts += own[a : a + draw.randrange(5, 45)] if draw.random() < 0.5 else own
        texts.append(draw.choice([" ", ", ", "\n"]).join(parts).title())
    texts.append("filler " * 4000 + items[4][1])
    docs = make(texts).withColumn("n", F.lit(0)).withColumn("doc", F.lit("x"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for chars in (decontaminate.BLOCK_CHARS, 300):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
        monkeypatch.setattr(decontaminate.test_blocks, "__defaults__", (chars,))
        got = contaminated(docs, spark, str(tmp_path)).collect()
        assert len(got) == len(texts)
        for r in got:
            own = plain_words(texts[r.doc_id])
            hit, names = set(), set()
            for name, text in items:
                item = plain_words(text)
                windows = [item[i : i + 13] for i in range(max(len(item) - 12, 1))] if item else []
                for w in windows:
                    for p in range(len(own) - len(w) + 1):
                        if own[p : p + len(w)] == w:
                            hit.update(range(p, p + len(w)))
                            names.update([] if name is None else [str(name)])
            assert (r.n_words, r.n_hit, r.n_items) == (len(own), len(hit), len(names)), r
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
            assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(own))
    assert contaminated(docs.limit(0), spark, str(tmp_path)).count() == 0


def test_values_of_credentials_stand_bare_elsewhere(spark, make):
    """A value that is assigned in one text is found as a word of another, if few have it."""
    rows = ["token=hunter2hunter2.", "we use hunter2hunter2, or hunter2hunter22", "hunter2hunter2=", "nothing"]
    rows = [(i, t, "en", "s0", 0) for i, t in enumerate(rows)]
    wide = [(10 + i, "secret: commonvalue99" if i < 3 else "see commonvalue99 x", "en", f"w{i}", 0) for i in range(9)]
    docs = make(rows + wide).withColumnRenamed("n_chars", "_live").withColumn("_h1", F.lit("mine"))
    got = secretscan.scanned(docs, "doc_id").select("doc_id", secretscan.spans_text().alias("spans"))
    spans = dict(got.collect())
    assert spans[0] == "assign:0:21" and spans[1] == "bare:7:21" and spans[2] == "bare:0:14"
    assert spans[3] == "" and spans[10] == "assign:0:21"
    # Nine owners have it, most of them bare: an example.
    assert all(spans[i] == "" for i in range(13, 19))
    red = {r.doc_id: r for r in secretscan.redacted(docs, "text", "#").collect()}
    assert red[1].text == "we use #, or hunter2hunter22" and red[10].text == "secret: commonvalue99"
    assert red[2].text == "#=" and red[0].text == "token=#" and red[1]._h1 == "mine" and red[1]._live == 0


def plain_near(texts, items, slop, rarest=3):
    """Of all places of the asked terms, the most different ones whose shifts are close."""
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())
    docs = [split(t) for t in texts]
    found = {}
    for name, text in items:
        own = split(text)
        size = min(13, len(own))
        frequency = {w: sum(d.count(w) for d in docs) for w in own}
        asked, places = [], set()
        number = {w: i for i, w in reversed(list(enumerate(own)))}
        for s in range(len(own) - size + 1 if own else 0):
            terms = own[s : s + size]
            if all(frequency[w] for w in terms):
                chosen = sorted(range(size), key=lambda o: (frequency[terms[o]], number[terms[o]], o))[:rarest]
                places |= {(terms[o], s + o) for o in chosen}
                asked.append(len(chosen))
        for n, d in enumerate(docs):
            shifts = sorted((p - o, o) for p, w in enumerate(d) for t, o in places if t == w)
            best = None
            for s, _ in shifts:
                offsets = {o for x, o in shifts if s <= x <= s + slop}
                if asked and len(offsets) >= min(asked) and (best is None or (len(offsets), -s) > best):
                    best = (len(offsets), -s)
            if best:
                found[n, name] = (best[0], -best[1])
    return found


@pytest.mark.parametrize("slop", [0, 2, 5])
def test_proximity(spark, make, slop):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu"
    draw = random.Random(slop)
    texts = [item, item.replace("gamma", "gamma x"), "alpha " * 20, item.replace(" ", " x x x x x "), None]
    texts += ["rare filler rare filler rare other", "rare uncommon x scarce", "scarce uncommon rare", "x rare x uncommon x scarce x"]
    words = ["rare", "uncommon", "scarce", "x", "alpha", "beta", "gamma", "nu"]
    texts += [" ".join(draw.choice(words) for _ in range(40)) for _ in range(30)]
    items = [("i", item), ("j", "rare uncommon scarce"), ("k", "missing words"), ("l", None), ("m", "alpha")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.proximity_matches(make(texts), bench, "doc_id", "item_id", slop=slop).collect()
    found = {(r.doc, r.item): (r.n, r.shift) for r in got}
    assert len(found) == len(got) and found == plain_near(texts, items, slop)
    assert (5, "j") not in found and ((6, "j") in found) == (slop > 0)


def test_items_without_an_id(spark, make, tmp_path):
    """They count as hits of words, not as items."""
    spark.createDataFrame([(None, "one two three"), ("i", "four five")], "item_id string, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    got = {r.doc_id: r for r in contaminated(make(["one two three four five", "one two three"]), spark, str(tmp_path)).collect()}
    assert (got[0].n_hit, got[0].n_items) == (5, 1) and (got[1].n_hit, got[1].n_items) == (3, 0)
    assert got[0].items_sha256 == hashlib.sha256(b"i").hexdigest() and got[1].contaminated


@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution(spark, make, rule):
    draw = random.Random(6)
    parts = ["word", " ", "\n", "é", "😀", "日本", "==", "Æther", "\n\n", "the", "ing"]
    texts = [*ODD, "\n\nab\n", "x" * 30_000] + ["".join(draw.choice(parts) for _ in range(30)) for _ in range(60)]
    docs = make(texts).withColumn("sections", F.lit(3))
    library = tiktoken.Encoding("o", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    cut = "transform(array(struct(3, 9), struct(0, 3), struct(12, 400)), x -> struct('f' as name, x.col1 as start, x.col2 as end))"
    for sections in (None, F.expr(cut)):
        got = attribution.attributed(docs, "text", PATH, PATTERN, sections, rule).collect()
        assert len(got) == len(texts)
        for r in got:
            text = texts[r.doc_id] or ""
            tokens = [library.decode_single_token_bytes(t) for t in library.encode_ordinary(text)]
            assert r.n_tokens == len(tokens)
            if sections is None:
                bounds = [0, *(i + 1 for i, c in enumerate(text) if c == "\n"), len(text)]
                want = [(a, b) for a, b in zip(bounds, bounds[1:]) if a < b]
                assert [(s.start, s.end) for s in r.sections] == want
            spans = [(len(text[: s.start].encode()), len(text[: s.end].encode())) for s in r.sections]
            total, at = [0.0] * len(spans), 0
            outside = 0.0
            for token in tokens:
                over = [max(0, min(b, at + len(token)) - max(a, at)) for a, b in spans]
                rest = len(token) - sum(over)
                if rule == "split":
                    for i, o in enumerate(over):
                        total[i] += o / len(token)
                    outside += rest / len(token)
                elif rule == "first":
                    own = [i for i, (a, b) in enumerate(spans) if a <= at < b]
                    if own:
                        total[own[0]] += 1
                    else:
                        outside += 1
                else:
                    best = max(range(len(over)), key=lambda i: (over[i], -i)) if over else None
                    if best is not None and over[best] >= rest and over[best] > 0:
                        total[best] += 1
                    else:
                        outside += 1
                at += len(token)
            assert [round(s.n_tokens, 6) for s in r.sections] == [round(x, 6) for x in total], (text, r)
            assert round(r.outside, 6) == round(outside, 6)
    assert attribution.attributed(docs.limit(0), "text", PATH, PATTERN).count() == 0


def test_joined_fields(spark):
    df = spark.createDataFrame([("ab", None), ("", "cde")], "title string, body string")
    text, sections = attribution.joined_fields({"title": df.title, "body": df.body})
    rows = attribution.attributed(df.withColumn("t", text), "t", PATH, PATTERN, sections, "first").collect()
    assert [[(s.name, s.start, s.end) for s in r.sections] for r in rows] == [
        [("title", 0, 2), ("body", 3, 3)],
        [("title", 0, 0), ("body", 1, 4)],
    ]
    with pytest.raises(ValueError):
        attribution.attributed(df, "title", PATH, PATTERN, rule="last")
