"""License notices planted in long, wrapped and repeated texts."""

import random

from codexlake.llm.licenses import TEMPLATES, Scanner, marks, pattern, scan_licenses

NOTICES = [(name, t) for name, group in TEMPLATES.items() for t in group]
PROSE = "the of and to a in this work is any or that software with under you may for by not be as at on it".split()


def prose(rng, n):
    return [rng.choice(PROSE) if rng.random() < 0.5 else f"w{rng.randrange(3000)}" for _ in range(n)]


def found(text):
    return [(n[1], n[4]) for n in Scanner(TEMPLATES, 0.8).scan(text)]


def test_every_notice_in_one_long_line():
    rng = random.Random(4)
    for name, notice in NOTICES:
        words = prose(rng, 8_000)
        words.insert(rng.randrange(len(words)), notice)
        assert found(" ".join(words)) == [(name, True)]


def test_all_notices_of_one_line():
    for joint in (" or ", " ", ". " + " ".join(prose(random.Random(1), 300)) + " "):
        assert found(joint.join(t for _, t in NOTICES)) == [(name, True) for name, _ in NOTICES]
    assert found(f"{NOTICES[0][1]} " * 50) == [("Apache-2.0", True)] * 50


def test_wrapped_notices():
    for name, notice in NOTICES:
        text = "first\n\n" + "\n# ".join(notice.split())
        (row,) = Scanner(TEMPLATES, 0.8).scan(text)
        assert (row[0], row[1], row[4]) == (2, name, True)


def test_changed_words():
    name, notice = next(x for x in NOTICES if x[1].startswith("Permission is hereby"))
    words = notice.split()
    words[5] = "cost"
    del words[20]
    words.insert(30, "gladly")
    gone = [Scanner.words(notice)[i] for i in (5, 20)]
    rng = random.Random(9)
    text = " ".join(["License."] + prose(rng, 500) + words + prose(rng, 500))
    (row,) = Scanner(TEMPLATES, 0.8).scan(text)
    assert row[1] == name == "MIT" and row[5] == ["cost", "gladly"] and row[6] == gone
    assert abs(row[3] - (1 - 2 / len(Scanner.words(notice)))) < 1e-9


def test_rows(spark):
    text = f"a\nb {NOTICES[0][1]} {NOTICES[3][1]}\n\nc\n{NOTICES[9][1]}"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "a license")], "doc_id long, text string")
    got = sorted((r.doc_id, r.line, r.license) for r in scan_licenses(docs).collect())
    assert got == sorted([(1, 1, NOTICES[0][0]), (1, 1, NOTICES[3][0]), (1, 4, NOTICES[9][0])])


def test_no_notice_lacks_all_marks():
    import re

    for _, notice in NOTICES:
        words = Scanner.words(notice)
        lost = len(words) - max(1, -(-8 * len(words) // 10))
        assert len(marks(words, 0.8)) == min(len(set(words)), lost + 1)
    found = re.compile(pattern(["ab", "abc", "b-c", "b.d"]))
    for text, hit in (("x ab", "ab"), ("ABC.", "ABC"), ("abcd", None), ("(b-c)", "b-c"), ("bxd", None), ("b.d", "b.d")):
        m = found.search(text)
        assert (m and m[0]) == hit, text
    assert len(TEMPLATES) >= 18


def brute(text, least=0.8):
    """The closest template of all, by the words in order that are missing or too many, over the whole text."""
    from codexlake.llm.licenses import differences

    words, best = Scanner.words(text), None
    for name, notice in NOTICES:
        expected = Scanner.words(notice)
        inserted, deleted = differences(expected, words)
        if 1 - len(deleted) / len(expected) >= least and len(inserted) <= max(40, len(expected)):
            key = (len(inserted) + len(deleted)) / len(expected), -len(expected)
            best = min(best or (key, name), (key, name))
    return best and best[1]


def test_changed_notices_against_brute_force():
    """Each notice alone with some words changed, left out or put in: the license of the closest wording of all templates."""
    rng = random.Random(17)
    for _, notice in NOTICES:
        words = notice.split()
        for _ in range(len(words) // 12):
            at = rng.randrange(1, len(words))
            change = rng.randrange(3)
            words[at : at + (change < 2)] = [] if change == 0 else [f"z{rng.randrange(99)}"]
        text = " ".join(words)
        got = Scanner(TEMPLATES, 0.8).scan(text)
        assert [r[1] for r in got][:1] == ([brute(text)] if brute(text) else []), text


def test_repeated_rows_ties_and_extra_columns(spark):
    text = NOTICES[0][1]
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "y"), (None, text, None)], "doc_id long, text string, license string")
    got = sorted(((r.doc_id or 0), r.license, r.exact) for r in scan_licenses(docs).collect())
    assert got == [(0, "Apache-2.0", True), (1, "Apache-2.0", True), (1, "Apache-2.0", True)]
    tied = {"B": ("shared words of two licenses",), "A": ("shared words of two licenses",)}
    assert [r[1] for r in Scanner(tied, 0.8).scan("shared words of two licenses")] == ["B"]  # of equal wordings the first template's
