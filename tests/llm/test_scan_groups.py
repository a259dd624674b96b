import random

from paperloom.llm import scan_repair as sr

from .test_scan_repair import LINE, RUN, corpus, pages


def misread(rng, word):
    """A word with any of its glyphs confused."""
    ways = [*sr.READ_AS.items(), *sr.SIGNS.items(), ("1", "l"), ("1", "i")]
    return "".join(rng.choice([c] + [seen for seen, printed in ways if printed == c]) for c in word)


def test_misreadings_share_a_group_and_are_read_back():
    rng = random.Random(8)
    for _ in range(3000):
        word = "".join(rng.choice("abcdefghilmnoqrstuvwy") for _ in range(rng.randrange(2, 14)))
        seen = misread(rng, word)
        assert sr.strokes(seen) == sr.strokes(word)
        assert seen == word or sr.read_from(seen, word)


def test_long_runs_of_signs_have_whole_originals_only():
    glyphs = sr.Glyphs({"iiiii": 9, "illillix": 50}, {}, 3)
    assert glyphs.options("1111111x") == {"illillix"} and glyphs.options("1ll1lliz") == frozenset()


def test_result_does_not_depend_on_chunks(spark):
    lines, runs = spark.createDataFrame(corpus() + pages(), LINE), spark.createDataFrame([], RUN)
    columns = "doc_id", "page", "line", "running", "hyphen", "misread", "repaired"
    got = [sorted(map(tuple, sr.judged_lines(lines, runs, n).select(*columns).collect())) for n in (1, 7)]
    assert got[0] == got[1] and got[0]


def test_what_is_asked_covers_lost_glyphs(spark):
    lines = [(f"k{n}", 1, "b", n, "x the tenant signed", None, None, "m", 1) for n in range(5)] + [("z", 1, "b", 1, "a the t�nan� s1gned", None, None, "m", 1)]
    got = sr.judged_lines(spark.createDataFrame(lines, LINE), spark.createDataFrame([], RUN)).where("doc_id = 'z'").first()
    assert got.repaired == "a the tenant signed" and got.misread == [1]
