import random

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from noticelake.llm.common import written
from noticelake.llm.packing import binary_lengths
from noticelake.llm.queries import tokenizer
from tests.llm.test_decontam import brute as contaminated_brute
from tests.llm.test_linededup import brute as lines_brute
from tests.llm.test_simhash import brute_fingerprint, components

PATH = tokenizer("word_bpe_49k.json")


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bcdfgklmn") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = "a line that very many of the documents share " + line(6)
    items = [(i, line(20)) for i in range(6)]
    rows, labels = [], []
    for i in range(150):
        bad = i % 6 == 0
        lines = [line(rng.randrange(8, 14)) for _ in range(rng.randrange(7, 12))]
        if i % 7 == 1:
            lines.insert(2, shared)
        if i % 11 == 2:
            lines[-1] += " " + items[i % 6][1]
        text = "\n".join(lines)
        rows.append((i, " ".join(w + "###" for w in text.split()) if bad else text))
        labels.append((i, int(not bad), 0))
    for i in range(20):  # near copies: one word changed in a long text
        words = rows[1 + 6 * (i % 3)][1].split(" ")
        words[len(words) // 2] = word()
        rows.append((200 + i, " ".join(words)))
    rows += [(300, None), (301, ""), (302, rows[2][1]), (3, rows[3][1]), (None, rows[4][1]), (None, line(80)), (303, line(5000))]
    return rows, labels, items


def save(spark, tmp_path):
    rows, labels, items = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs, rows, items


def test_each_stage_against_brute_force(spark, tmp_path):
    docs, rows, items = save(spark, tmp_path)
    left = rows
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = len(left)
        docs = written(stage(spark, docs, str(tmp_path)), name)
        if name == "packing":
            break
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "quality_rules":
            left = [(i, t) for i, t in left if len((t or "").split()) >= 50 and "###" not in t]
        elif name == "line_dedup":
            left = [(None if i == "None" else int(i), t) for i, t, _, _ in lines_brute(left)]
            seen.append(any("very many of the documents share" in t for _, t in left))
        elif name == "near_dedup":
            prints = {brute_fingerprint(t) for _, t in left}
            comp = components(sorted(prints), [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3])
            least = {}  # one row of each group: the smallest id, rows without one last
            for i, t in sorted(left, key=lambda r: (r[0] is None, r[0] or 0)):
                least.setdefault(comp[brute_fingerprint(t)], (i, t))
            left = list(least.values())
            assert len(left) < before and sum(i is None for i, _ in left) == 1  # the other was a copy of a row with an id
        else:
            bad = {r[0] for r in contaminated_brute([(k, t) for k, (_, t) in enumerate(left)], items) if r[5]}
            assert bad
            left = [r for k, r in enumerate(left) if k not in bad]
        got = docs.collect()
        assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), t) for i, t in left), name
        assert all(r.n_chars == len(r.text) for r in got)
    whole = Tokenizer.from_file(PATH)
    want = []
    for i, t in left:
        ids, start = [*whole.encode(t, add_special_tokens=False).ids, 1], 0
        for n in binary_lengths(len(ids)):
            want.append((str(i), start, n, tuple(ids[start : start + n])))
            start += n
    assert sorted((str(r.doc_id), r.start, r.length, tuple(np.array(r.ids))) for r in docs.collect()) == sorted(want)
    assert seen == [True]


def test_run_is_the_stages_in_order(spark, tmp_path):
    save(spark, tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id", "offset"] and got.count() > 0
