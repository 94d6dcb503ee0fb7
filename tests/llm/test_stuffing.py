import random
import re
from collections import Counter

import pytest

from colophon.llm.stuffing import corpus_counts, distinct_texts, score_pages, stuffed_pages, tokens

NOUNS = [a + b for a in ("riv", "ston", "lan", "har", "win", "grav", "led", "prom", "mir", "sea") for b in ("er", "ern", "our", "ow", "ity", "ger", "ise", "ror", "son", "ect")]


def prose(seed, n=30):
    r = random.Random(seed)
    shapes = ["the {} of the {} holds a {}", "we never saw how the {} came to a {}", "between {} and {} there lies a {}", "if the {} fails then the {} will end"]
    return " ".join((r.choice(shapes).format(*r.choices(NOUNS, k=3)) + ".").capitalize() for _ in range(n))


ADS = ["buy now", "best price", "free pdf", "cheap books", "rare book", "full text", "study guide", "audiobook"]


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(0)
    link = lambda: f"https://www.{r.choice(NOUNS)}{r.randrange(99)}.example/{r.choice(NOUNS)}"
    rows = [(i, prose(i)) for i in range(200)]
    spam = {
        1000: " | ".join(f"river {r.choice(ADS)}" for _ in range(80)),
        1001: "\n".join(link() for _ in range(30)),
        1002: " ".join(f"#river{r.choice(ADS).replace(' ', '')}" for _ in range(60)),
        1003: " ".join(r.choice(["river", "river", *ADS]) for _ in range(200)),
        1004: prose(1, 5) + " " + ", ".join(f"ledger {r.choice(ADS)}" for _ in range(150)),
        1005: "\n".join(f"SKU {r.randrange(99999)} - ledger - {r.choice(ADS)} - EUR {r.randrange(99)}.99" for _ in range(40)),
    }
    fine = {
        2000: "Index\n\n" + "\n".join(f"{r.choice(NOUNS)}, {r.choice(NOUNS)}, {r.randrange(400)}, {r.randrange(400)}" for _ in range(60)),
        2001: "\n".join(f"O river, {prose(s, 1)}" for s in range(20)),
        2002: prose(3, 20) + " See " + link() + " and pay EUR 5.00 #river",
        2003: None, 2004: "", 2005: "word", 2006: prose(4, 3000),
        2007: prose(9, 30) + " " + ", ".join(f"ledger {r.choice(ADS)}" for _ in range(15)),
    }
    rows += [*spam.items(), *fine.items(), (1000, spam[1000])]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id bigint, text string, stuffed double")
    return df, set(spam), set(fine)


def test_spam_and_prose_apart(corpus):
    df, spam, fine = corpus
    got = [r["doc_id"] for r in stuffed_pages(df).collect()]
    assert set(got) == spam
    assert got.count(1000) == 2  # repeated rows stay


def test_copies_do_not_vouch(spark):
    r = random.Random(5)
    spam = " | ".join(f"ledger {r.choice(ADS)}" for _ in range(80))
    bag = " ".join(r.choice(["harow", "harow", *ADS]) for _ in range(200))
    copies = [(1000 + i, spam) for i in range(40)] + [(2000 + i, bag) for i in range(40)]
    copies += [(3000 + i, f"Page {i}\n\n{spam.upper()} {i}.00") for i in range(20)]  # but for case and figures
    rows = [(i, prose(i)) for i in range(200)] + copies  # a third of the rows
    got = {x["doc_id"] for x in stuffed_pages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i for i, _ in copies}


def test_one_row_a_row(corpus):
    df, *_ = corpus
    scores = score_pages(df).collect()
    assert len(scores) == df.count() and all(0 <= r["stuffed"] <= 1 for r in scores)
    assert all(r["stuffed"] == 0 for r in scores if r["doc_id"] in (2003, 2004, 2005))


def test_empty_table(corpus):
    assert stuffed_pages(corpus[0].limit(0)).count() == 0


def plain_tokens(text):
    import regex

    found = regex.findall(r"(?:https?://|www\.)[^\s\"'<>()\[\]]*|#[\p{L}\p{N}_-]+|[\p{L}]+", (text or "").lower())
    return ["\1" if t.startswith(("http://", "https://", "www.")) else "\2" if t[0] == "#" else t for t in found]


def test_tokens_against_a_regular_expression():
    texts = ["Éa http://a.b/#c 1,2 #x-y www.q.r end", "", "a-b  c'd (www.z) #", "https://x ab#cd 12ab", "x" * 70_000 + " y"]
    numbers, lengths, docs = tokens(texts)
    want = [(i, t) for i, text in enumerate(texts) for t in plain_tokens(text)]
    assert docs.tolist() == [i for i, _ in want]
    named = {}
    for (_, t), n in zip(want, numbers.tolist()):
        assert named.setdefault(t, n) == n
    assert len(set(named.values())) == len(named)
    assert lengths.max() == 70_000


def test_counts_are_exact(corpus):
    df, *_ = corpus
    texts = [r["text"] for r in distinct_texts(df, "text").collect()]
    words, pairs = Counter(), Counter()
    for t in texts:
        w = plain_tokens(t)
        words.update(set(w))
        pairs.update(set(zip(w, w[1:])))
    got = corpus_counts(distinct_texts(df, "text"), "text").collect()
    assert sorted(r["n"] for r in got if r["a"] is not None and r["b"] is None) == sorted(words.values())
    assert sorted(r["n"] for r in got if r["b"] is not None) == sorted(pairs.values())
    assert [r["n"] for r in got if r["a"] is None] == [len(texts)]


def test_bounds_of_the_broadcast_change_nothing(corpus):
    df, *_ = corpus
    key = lambda r: (r["doc_id"], r["mean_pmi"] is None, round(r["mean_pmi"] or 0, 9), round(r["stuffed"], 9))
    whole = sorted(key(r) for r in score_pages(df).collect())
    assert sorted(key(r) for r in score_pages(df, most_words=3, most_pairs=5).collect()) == whole
    assert sorted(key(r) for r in score_pages(df, most_words=0, most_pairs=0).collect()) == whole


def test_many_corpora_side_by_side(corpus, spark):
    """Flags stay as they are when the corpus stands beside others in other words."""
    df, spam, _ = corpus
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    other = lambda t, k: t and re.sub(r"[^\W\d_]+", lambda m: m[0] if m[0] in ("https", "www") else m[0] + "abcdefghijklmnopqrst"[k] * 3, t)
    many = [(10_000 * k + i, other(t, k)) for k in range(20) for i, t in rows]
    got = {r["doc_id"] for r in stuffed_pages(spark.createDataFrame(many, "doc_id bigint, text string").repartition(8)).collect()}
    assert got == {10_000 * k + i for k in range(20) for i in spam}


def test_the_mean_pmi_decides(corpus):
    """Without the page's own frequencies in the PMI nothing is flagged; the flags are its doing alone."""
    df, spam, _ = corpus
    means = {r["doc_id"]: r["mean_pmi"] for r in score_pages(df).collect() if r["mean_pmi"] is not None}
    prose_means = [v for k, v in means.items() if k < 200]
    assert max(means[i] for i in spam if i != 1004) < min(prose_means)
