"""Words scored from both sides, against counts in plain Python."""

import math
import random
from collections import Counter

from loomgraph.llm import scoring, word_scoring

SF = "/root/testdata/sf0.001"


def plain_scores(texts, network):
    """Each text against all others, with dicts."""
    texts = [word_scoring.words_of(t) for t in texts]
    own = [(Counter(t), Counter(zip([0, *t], [*t, 1]))) if t else (Counter(), Counter()) for t in texts]
    words, pairs = sum((a for a, _ in own), Counter()), sum((b for _, b in own), Counter())
    n, k = sum(words.values()), word_scoring.WEIGHT
    once, ends = sum(c == 1 for c in words.values()), sum(bool(t) for t in texts) - 1
    names = list(words)
    spelling = dict(zip(names, word_scoring.spelled(names, network).tolist()))
    out = []
    for t, (a, b) in zip(texts, own):
        total = 0.0
        for i, w in enumerate(t):
            l, r = t[i - 1] if i else 0, t[i + 1] if i + 1 < len(t) else 1
            c = lambda x: words[x] - a[x] if isinstance(x, str) else ends  # noqa: B023, E731
            rest = n - len(t)
            u = (once + 1) / (n + 2) if rest else 1
            alone = (1 - u) * c(w) / max(1, rest)
            sides = [((l, w), c(l)), ((w, r), c(r))]
            seen = sum((pairs[p] - b[p] + k * alone) / (m + k) for p, m in sides) / 2
            back = math.log(u * sum(k / (m + k) for _, m in sides) / 2) + spelling[w]
            total += max(back, math.log(seen)) + math.log1p(math.exp(-abs(back - math.log(seen)))) if seen else back
        out.append((len(t), total))
    return out


def test_word_scores_are_those_of_plain_counts(spark, odd, none):
    network = scoring.train(odd)
    rows = odd.collect()
    want = {r["text"]: s for r, s in zip(rows, plain_scores([r["text"] for r in rows], network))}
    for chunk in (50, word_scoring.CHUNK_CHARS):
        got = word_scoring.score_words(odd, network, chunk_chars=chunk).collect()
        assert len(got) == len(rows) and Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in rows)
        for r in got:
            n, total = want[r["text"]]
            assert r["n_tokens"] == n and math.isclose(r["log_likelihood"], total, rel_tol=1e-9, abs_tol=1e-9)
            assert (r["mean_log_likelihood"] is None) == (n == 0)
    assert word_scoring.score_words(none, network).count() == 0


def test_words_of_every_script_are_told_apart(spark):
    """Real sentences score above shuffled and repeated ones and above words nobody
    else has, where letters alone are all one class."""
    rng = random.Random(2)
    known = ["мама мыла белую раму утром", "я вижу большой синий дом", "δεν ξέρω τι να κάνω τώρα", "我们今天去学校学习中文", "هذا كتاب جديد عن التاريخ"]
    rows = [(i, known[i % 5]) for i in range(60)]
    odd_ones = {100: "раму белую утром мыла мама", 101: "мыма ламу бетую рамо утлом", 102: "中学文去习们今校天学我", 103: "τνω ξέδν ρω τνι κάω ατρ", 104: "ъыэщъ " * 5}
    letters = list(known[4].replace(" ", ""))
    rng.shuffle(letters)
    odd_ones[105] = "".join(letters)
    docs = spark.createDataFrame(rows + list(odd_ones.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["mean_log_likelihood"] for r in word_scoring.score_words(docs, scoring.train(docs)).collect()}
    assert min(got[i] for i in range(60)) > max(got[i] for i in odd_ones) + 1


def test_what_is_gathered_grows(spark):
    """Every distinct word and pair of the corpus has its count."""
    from pyarrow.fs import FileSelector

    from loomgraph.llm.token_files import place

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for part in (docs.where("doc_id % 4 = 0"), docs):
        counts = word_scoring.count_words(part.select("doc_id", "text"))
        texts = [word_scoring.words_of(r["text"]) for r in part.select("text").collect()]
        words = Counter(w for t in texts for w in t)
        assert (counts.words, counts.once, counts.texts) == (sum(words.values()), sum(c == 1 for c in words.values()), sum(map(bool, texts)))
        files, path = place(counts.folder)
        n = [int(word_scoring._counts(files.open_input_stream(f.path).read())[0]) for f in files.get_file_info(FileSelector(path))]
        assert sum(n) >= len(words)
