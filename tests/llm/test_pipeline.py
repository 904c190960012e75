"""Each stage of the pipeline, and run() as a whole, against brute force; ids repeat and are null."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = {"en": "the of and house tree river walk under stone light", "de": "der und haus baum fluss gehen unter stein licht nicht"}


def prose(n, lang, seed):
    r = random.Random(seed)
    stems = VOCABULARY[lang].split()
    return [r.choice(stems) + ("" if r.random() < 0.5 else "".join(r.choices("aeinrst", k=3))) for _ in range(n)]


def lines(w):
    return "\n".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows = []
    for k in range(30):
        lang = "en" if k % 2 else "de"
        rows.append((k, lines(prose(70 + k, lang, k)), lang))
    base = prose(90, "en", 500)
    rows += [(40, " ".join(base), "en"), (41, " ".join(base), "en"), (41, " ".join([*base[:50], "changed", *base[51:]]), "en"), (None, " ".join(base), "en"), (None, " ".join(prose(80, "de", 501)), "de")]
    # shares its id with a copy, but not its text
    rows += [(40, " ".join(prose(85, "en", 502)), "en")]
    shared = [" ".join(prose(12, "en", 600 + i)) for i in range(4)]
    rows += [(50 + k, "\n".join([" ".join(prose(30, "en", 700 + k)), *shared, " ".join(prose(30, "en", 720 + k))]), "en") for k in range(3)]
    rows += [(60, "\n".join(shared), "en")]
    item = prose(40, "en", 800)
    rows += [(70, " ".join([*prose(20, "en", 801), *item, *prose(20, "en", 802)]), "en")]
    rows += [(80, None, None), (81, "", "en"), (82, "123 456", "en"), (83, "  \n ", None), (83, "  \n ", None)]
    folder = tmp_path_factory.mktemp("sf")
    docs = [(i, t, lang, "s", len(t) if t is not None else None) for i, t, lang in rows]
    spark.createDataFrame(docs, SCHEMA).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), str(folder)


def texts(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def deduplicated(rows):
    """Lines that no repeated window of three covers, and how many went; rows of one id and text are one document."""
    found, seen = {}, set()
    order = sorted({(i, t) for i, t in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0))
    for i, t in order:
        parts = t.split("\n")
        solid = [k for k, x in enumerate(parts) if x.strip(" ")]
        gone = set()
        for at in range(len(solid) - 2):
            key = tuple(parts[solid[at + j]].strip(" ") for j in range(3))
            if key in seen:
                gone.update(solid[at : at + 3])
            seen.add(key)
        found[i, t] = ("\n".join(x for k, x in enumerate(parts) if k not in gone), len(gone))
    return found


def shingled(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_language(spark, tables):
    docs, folder = tables
    got = corpus_pipeline.identify_language(spark, docs, folder)
    assert got.columns == docs.columns
    assert texts(got) == Counter({k: n for k, n in texts(docs).items() if k[0] not in (80, 81, 82, 83)})


def test_line_dedup(spark, tables):
    docs, folder = tables
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = deduplicated(rows)
    expected = Counter()
    for i, t in rows:
        text, gone = want[i, t] if t is not None else (None, 0)
        if not gone or text.strip(" "):
            expected[i, text] += 1
    got = corpus_pipeline.dedup_lines(spark, docs, folder)
    assert got.columns == docs.columns and texts(got) == expected
    assert (60, "\n".join([])) not in texts(got) and all(r.n_chars == len(r.text) for r in got.where("text is not null").collect())


def test_one_of_similar_stays(spark, tables):
    docs, folder = tables
    rows = docs.collect()
    sets = [shingled(r.text) for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    groups = Counter(find(k) for k in range(len(rows)) if sets[k])
    got = corpus_pipeline.keep_one_of_similar(spark, docs, folder)
    assert got.columns == docs.columns and got.count() == len(groups) + sum(not s for s in sets)
    of_text = {}
    for k, r in enumerate(rows):
        of_text[r.doc_id, r.text] = find(k) if sets[k] else None
    kept = Counter(of_text[r.doc_id, r.text] for r in got.collect())
    assert all(kept[g] == 1 for g in groups)
    unique = docs.where("doc_id < 40 or doc_id between 50 and 79")
    assert texts(corpus_pipeline.keep_one_of_similar(spark, unique, folder)) == texts(unique)


def test_benchmark_goes(spark, tables):
    docs, folder = tables
    got = corpus_pipeline.remove_benchmark(spark, docs, folder)
    assert texts(got) == Counter({k: n for k, n in texts(docs).items() if k[0] != 70})


def encoded(i, t):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path(corpus_pipeline.VOCABULARY))
    ids = library.encode(t or "", add_special_tokens=False).ids
    text = library.decode(ids, skip_special_tokens=False)
    return i, len(ids), np.array(ids, "<u4").tobytes(), hashlib.sha256(text.encode()).hexdigest()


def test_tokens(spark, tables):
    docs, folder = tables
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in corpus_pipeline.encode_tokens(spark, docs, folder).collect())
    assert got == Counter(encoded(r.doc_id, r.text) for r in docs.collect())


def test_run_is_the_stages_one_by_one(spark, tables):
    docs, folder = tables
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    want = Counter((r.doc_id, r.n_tokens, bytes(r.ids)) for r in docs.collect())
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids)) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == want and {60, 70, 80, 81, 82, 83}.isdisjoint(i for i, *_ in got) and len(want) > 30


def test_empty(spark, tables):
    docs, folder = tables
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), folder).count() == 0
