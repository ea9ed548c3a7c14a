"""Stages of the corpus pipeline on rows without an id of their own."""

import random
import re

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from logsig.llm import bpe, decontaminate, secretscan, toxicity
from logsig.llm.queries import contaminated

from .conftest import ODD
from .test_simhash import components
from .test_simhash import plain as fingerprint

WORDS = ["".join(c) for c in zip("bcdfglmnprst" * 9, "aeiou" * 22, "lmnrstvbd" * 12, "aeiou" * 22)]
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu"


def test_contamination_is_judged_by_the_own_text(spark, make, tmp_path):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu"
    spark.createDataFrame([("i", item)], "item_id string, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    rows = [(None, item), (None, "clean words"), (None, None), (3, f"{item} more"), (3, "clean too"), (4, "")]
    docs = make([(i, t, "en", "s", 0) for i, t in rows])
    got = [(r.doc_id, r.n_words, r.n_hit) for r in contaminated(docs, spark, str(tmp_path)).collect()]
    want = [(None, 13, 13), (None, 2, 0), (None, 0, 0), (3, 14, 13), (3, 2, 0), (4, 0, 0)]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()
    left = [rows[i] for i in (1, 2, 4, 5)]
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(left, key=str)


def test_blocks_hold_a_repeated_item_once(spark):
    rows = [(1, "same words")] * 200 + [(2, "other words"), (1, "other words"), (None, None), (None, None)]
    bench = spark.createDataFrame(rows, "item_id int, text string")
    for chars in (1000, 10):
        got = [r for b in decontaminate.test_blocks(bench, "item_id", "text", chars) for r in b]
        assert sorted(got, key=str) == sorted(set(rows), key=str)


class Broken:
    def encode(self, text):
        return np.zeros(1, "<u4").tobytes()

    def decode(self, ids):
        return b"something else"


def test_encoding_is_checked_by_decoding(spark, make):
    with pytest.raises(ValueError):
        bpe._checked_ids(Broken(), "text")
    docs = corpus_pipeline.encode(spark, make(ODD), "")
    plan = bpe.decoded(docs, "token_ids", corpus_pipeline.public_tokenizers.path(corpus_pipeline.BPE_RANKS))
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in plan.collect())


def prose(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n))


def corpus():
    """Toxic texts, copies and near copies, contaminated texts, secrets, null and repeated ids."""
    draw = random.Random(12)
    rows, labels = [], []
    for i in range(160):
        text = ". ".join(prose(draw, 9) for _ in range(4))
        if i % 4 == 0:
            text += f". {prose(draw, 3)} idiot scum {prose(draw, 2)}"
        labels.append((i, 0, int(i % 4 == 0)))
        rows.append((i, text))
    copy = prose(draw, 120)
    rows += [(300 + i, copy) for i in range(5)] + [(310, copy + " more"), (None, copy)]
    # One id leads three groups; rows without an id are of two groups.
    rows += [(320, prose(draw, 60)), (320, prose(draw, 61)), (320, prose(draw, 62)), (None, prose(draw, 50)), (None, prose(draw, 50))]
    rows += [(330, f"{prose(draw, 20)} {ITEM} {prose(draw, 9)}"), (331, f"{prose(draw, 400)} {ITEM} {prose(draw, 300)}"), (None, f"{ITEM} {prose(draw, 3)}")]
    rows += [(340 + i, f"{prose(draw, 30)} token=sharedvalue00 {prose(draw, 9)}") for i in range(8)]
    rows += [(350, f"{prose(draw, 30)} secret: 'ownvalue123456' {prose(draw, 9)}"), (351, f"{prose(draw, 31)} ownvalue123456 {prose(draw, 8)}")]
    rows += [(360 + i, t) for i, t in enumerate(ODD)]
    docs = [(i, t, "en", f"s{n % 7}" if i and 340 <= i < 350 else "s0", len(t or "")) for n, (i, t) in enumerate(rows)]
    return docs, labels


def folder_of(spark, make, path, docs, labels):
    make(docs).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([("i", ITEM)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=str)


def plain_groups(docs):
    """Of each group of near copies the row with the smallest id, then the smallest text."""
    prints = [(r[0], fingerprint(r[1])) for r in docs]
    distinct = {p for _, p in prints}
    label = {p: p for p in distinct}
    while True:
        low = {p: min(label[q] for q in distinct if (p ^ q).bit_count() <= 3) for p in distinct}
        if low == label:
            break
        label = low
    groups = {}
    for row, (_, p) in zip(docs, prints, strict=True):
        groups.setdefault(label[p], []).append(row)
    assert len(set(components(prints).values()) - {None}) <= len(groups)
    return groups


def plain_hits(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower())
    item, hit = ITEM.split(), set()
    for p in range(len(words) - len(item) + 1):
        if words[p : p + len(item)] == item:
            hit.update(range(p, p + len(item)))
    return len(hit) > 0 and 20 * len(hit) >= len(words)


def plain_redacted(docs):
    """Values of base matches that fewer than five sources have, cut out with their bare forms."""
    cut = {}
    values = {t[v:e].strip(".=-") for _, t, *_ in docs for _, k, e, v, _ in secretscan.candidates(t or "")}
    found = []
    for row in docs:
        text = row[1] or ""
        own = [(v, e) for _, _, e, v, _ in secretscan.candidates(text)]
        for m in re.finditer("[A-Za-z0-9+/_.=-]{12,}", text):
            if m[0] in values and not any(a < m.end() and m.start() < b for a, b in own):
                own.append((m.start(), m.end()))
        found.append(own)
        for a, b in own:
            cut.setdefault(text[a:b].strip(".=-"), set()).add(row[3])
    out = []
    for (i, text, lang, source, n), own in zip(docs, found, strict=True):
        live = [(a, b) for a, b in own if len(cut[text[a:b].strip(".=-")]) < 5]
        text = secretscan.cut_out(text, live, "[SECRET]") if live else text
        out.append((i, text, lang, source, None if text is None else len(text)))
    return out


def test_run_and_each_stage_against_plain_python(spark, make, tmp_path):
    docs, labels = corpus()
    folder = folder_of(spark, make, tmp_path, docs, labels)
    stages = [f for _, f in corpus_pipeline.STAGES]
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    # Toxicity: as the fitted model says of each text.
    model = corpus_pipeline.toxicity_model(documents, spark, folder)
    own = toxicity.Model(model.weights, model.leak)
    clean = [r for r in docs if own.score(r[1] or "")[0] < 0.5]
    assert 0 < len(docs) - len(clean) <= 44
    kept = stages[0](spark, documents, folder)
    assert rows_of(kept) == sorted(clean, key=str)
    # Near copies: one row of each group, also where an id leads several or is missing.
    groups = plain_groups(clean)
    single = stages[1](spark, make(clean), folder).collect()
    assert len(single) == len(groups)
    texts = {}
    for r in single:
        texts.setdefault(fingerprint(r.text), []).append(r)
    for label, rows in groups.items():
        mine = [r for p, rs in texts.items() for r in rs if any(fingerprint(x[1]) == p for x in rows)]
        ids = [x[0] for x in rows if x[0] is not None]
        assert len(mine) == 1 and mine[0].doc_id == (min(ids) if ids else None)
    assert sum(r.doc_id == 320 for r in single) == 3
    unique = [tuple(r) for r in single]
    # Contamination and secrets.
    fine = [r for r in unique if not plain_hits(r[1])]
    assert rows_of(stages[2](spark, make(unique), folder)) == sorted(fine, key=str)
    assert {r[0] for r in unique} - {r[0] for r in fine} == {330}
    redacted = plain_redacted(fine)
    assert rows_of(stages[3](spark, make(fine), folder)) == sorted(redacted, key=str)
    changed = {r[0] for r in redacted if "[SECRET]" in (r[1] or "")}
    assert changed == {350, 351}
    # The whole, with token ids as the library gives them.
    library = tiktoken.Encoding(
        "o", pat_str=corpus_pipeline.public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks=bpe.read_ranks(corpus_pipeline.public_tokenizers.path(corpus_pipeline.BPE_RANKS)),
    )
    got = corpus_pipeline.run(spark, folder)
    assert rows_of(got) == sorted(redacted, key=str)
    for r in got.collect():
        assert r.token_ids == library.encode_ordinary(r.text or "") and r.n_tokens == len(r.token_ids)


def test_stages_keep_columns_of_any_name(spark, make, tmp_path):
    docs, labels = corpus()
    folder = folder_of(spark, make, tmp_path, docs, labels)
    own = ["score", "predicted", "token_ids", "n_tokens", "_row", "_digest", "_id", "_h1", "_live", "a.b", "fp"]
    wide = make(docs)
    for name in own:
        wide = wide.withColumn(name, F.lit(f"mine {name}"))
    for _, stage in corpus_pipeline.STAGES:
        wide = stage(spark, wide, folder)
        assert wide.columns[: 5 + len(own)] == ["doc_id", "text", "lang", "source", "n_chars", *own]
    row = wide.filter("doc_id = 350").first()
    assert all(row[name] == f"mine {name}" for name in own)
    assert row["n_tokens_"] == len(row["token_ids_"]) and "[SECRET]" in row.text


def test_stages_of_an_empty_table(spark, make, tmp_path):
    folder = folder_of(spark, make, tmp_path, [], [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, make([]), folder).count() == 0
    assert corpus_pipeline.run(spark, folder).count() == 0
