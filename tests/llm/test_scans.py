import random

import pytest

from colophon.llm.scans import CUT, align, confusions, found_repairs, furniture, join_lines, readings, repaired_texts, tokens, train_editor

VOCABULARY = ["".join(p) for p in [(a, b, c) for a in ("mod", "har", "wit", "lan", "sol", "ver", "cur", "bel") for b in ("er", "in", "al", "um", "ed") for c in ("ness", "ment", "tion", "ing", "ure", "hold")]] + ["the", "and", "of", "with", "through", "thing-body"]
NOISE = [("m", "rn"), ("e", "c"), ("h", "b"), ("s", "5"), ("d", "cl"), ("n", "u"), ("l", "1"), ("o", "0")]


def sentence(r):
    return " ".join(r.choice(VOCABULARY) for _ in range(9)).capitalize() + "."


def scan(text, r, page, width=50):
    """A text as a printed page shows it, with what was done to it."""
    lines, truth, line = [], set(), ""
    for word in text.split(" "):
        shown = word
        if r.random() < 0.08 and len(word) > 5:
            right, wrong = r.choice([n for n in NOISE if n[0] in word.lower()] or [("", "")])
            if right:
                shown = word.replace(right, wrong, 1)
                if shown != word:
                    truth.add(word.lower().strip("."))
        if len(line) + len(shown) + 1 > width:
            room = width - len(line) - 2
            if room > 3 and len(shown) - room > 3 and shown.isalpha():
                lines.append(f"{line} {shown[:room]}-")
                line = shown[room:]
                truth.add(word.lower().strip("."))
                continue
            lines.append(line)
            line = shown
        else:
            line = f"{line} {shown}" if line else shown
    lines.append(line)
    furniture_line = f"THE SILENT BOOK  {page}"
    half = len(lines) // 2
    return "\n".join([*lines[:half], "", furniture_line, "", *lines[half:]]), truth, furniture_line


@pytest.fixture(scope="module")
def chunks(spark):
    r = random.Random(7)
    rows, words, lines, texts = [], set(), set(), {}
    for i in range(400):
        rows.append((f"clean{i}", " ".join(sentence(r) for _ in range(5)), "a.epub", i, i, "", 0.5))
    for i in range(200):
        text = " ".join(sentence(r) for _ in range(6))
        shown, truth, line = scan(text, r, 100 + i)
        rows.append((f"scan{i}", shown, "1900 The Silent Book - X.pdf", 98 + i, 99 + i, "", 0.5))
        words |= {(f"scan{i}", w) for w in truth}
        lines.add((f"scan{i}", line))
        texts[f"scan{i}"] = text
    rows += [("null", None, None, None, None, None, None), ("empty", "", None, 0, 0, None, None), rows[-1], ("long", "word " * 60000, None, 1, 1, "", 0.1), ("key", "k9" * 5000 + "\nx y\nz", None, 1, 1, "", 0.1)]
    schema = "chunk_id string, text string, source string, page_start int, page_end int, heading string, raw double"
    return spark.createDataFrame(rows, schema), words, lines, texts


def test_found_words_and_lines(chunks):
    df, words, lines, _ = chunks
    got = found_repairs(df).collect()
    found = {(r["chunk_id"], r["value"]) for r in got if r["kind"] == "word"}
    assert len(got) == len({tuple(r) for r in got})
    assert {(r["chunk_id"], r["value"]) for r in got if r["kind"] == "line"} == lines
    assert len(found & words) / len(words) > 0.97 and len(found & words) / len(found) > 0.97


def test_texts_come_back(chunks):
    df, _, _, texts = chunks
    got = {r["chunk_id"]: r["repaired"] for r in repaired_texts(df).collect()}
    assert len(got) == df.select("chunk_id").distinct().count() and got["null"] is None and got["empty"] == ""
    same = [got[k] == t for k, t in texts.items()]
    assert sum(same) / len(same) > 0.85


def test_empty_table(chunks):
    assert found_repairs(chunks[0].limit(0)).count() == 0


def test_furniture_by_position():
    lines = ["some running text that goes on and", "p. 112", "Author / THE BOOK OF HOURS", "continues here with more of it.", "", "   118", "", "It was built in", "1823.", "- 119 -", "Chapter Heading Here", "Das Haus und die Nacht. Was Anna"]
    marks = furniture(lines, 115, 116, "Chapter heading here", "x")
    assert [x for x, m in zip(lines, marks) if m] == ["p. 112", "Author / THE BOOK OF HOURS", "   118", "- 119 -", "Chapter Heading Here"]


def test_joining():
    assert join_lines(["a com-", None, "munity of", "minds.", "", "Next one"]) == f"a com{CUT}munity of minds.\n\nNext one"
    assert join_lines(["half a para", "", None, "", "graph goes on."]) == "half a para graph goes on."
    assert tokens("It's (a) thing-body, 1945 and !nside 5oul") == ["it's", "a", "thing-body", "and", "!nside", "5oul"]


def test_editor_learns_held_out_words():
    r = random.Random(1)
    words = [w for w in VOCABULARY if len(w) > 4 and w.isalpha()]
    seen, held = words[::2], words[1::2]
    lexicon = {w: 50 for w in words}
    noisy = [w.replace(a, b, 1) for w in seen for a, b in NOISE if a in w]
    _, ops = confusions(noisy, {w: 50 for w in seen})
    assert {("rn", "m"), ("c", "e"), ("cl", "d")} <= set(ops)
    editor = train_editor(noisy, {w: 50 for w in seen})
    tests = [(w.replace(a, b, 1), w) for w in held for a, b in [r.choice([n for n in NOISE if n[0] in w] or [("", "")])] if a]
    right = sum(w in [x for x, _, base in readings(bad, editor, {}) if not base] for bad, w in tests)
    assert right / len(tests) > 0.9
    assert lexicon


def test_labels_rebuild_the_word():
    for wrong, right in (("prornise", "promise"), ("thmk", "think"), ("clomain", "domain"), ("abc", "abc")):
        assert "".join(align(wrong, right)) == right
    assert align("abc", "vwxyz") is None


def test_line_ends_are_joined_by_the_editor():
    """The editor is trained on words cut at random and on compounds cut at their hyphens; neither test word is known."""
    from colophon.llm.scans import CUT, joins, train_editor

    firsts, lasts = ("counter", "self", "anti", "half"), ("memory", "image", "sense", "matter", "weight", "force", "truth", "light")
    plain = [a + b for a in ("sur", "mar", "con", "per", "dis", "tran") for b in ("face", "gins", "duct", "form", "turb", "mission", "sition")]
    lexicon = {f"{a}-{b}": 9 for a in firsts for b in lasts[:-1]} | dict.fromkeys(plain, 20)
    editor = train_editor([], lexicon)
    best = lambda raw: min(joins(raw, editor), key=lambda x: x[1])[0]
    assert best(f"counter{CUT}light") == "counter-light" and best(f"self{CUT}light") == "self-light"
    assert best(f"surd{CUT}uct") == "surduct" and best(f"mar{CUT}form") == "marform"
    assert joins("whole", editor) == [("whole", 0.0)]
