from paperloom.llm import scan_repair as sr


def test_neighbours_decide_for_long_words():
    words = {"table": 30, "fable": 10, "heard": 100, "beard": 10}
    pairs = {"the table": 20, "table of": 20, "we heard": 60, "the beard": 6, "beard trimmer": 8}
    glyphs = sr.Glyphs(words, pairs, 3)
    assert glyphs.judge("fable", "the", "of") == (True, "table")  # known, and its original isn't eight times as frequent
    assert glyphs.judge("fable", "late", "left") == (False, "fable")
    assert glyphs.judge("beard", "", "trimmer") == (False, "beard")  # its original is ten times as frequent
    assert glyphs.judge("beard", "a", "b") == (True, "heard")


def test_neighbours_choose_among_originals():
    two = sr.Glyphs({"heater": 100, "beater": 20}, {"egg beater": 9}, 3)
    assert two.judge("beafer", "egg", "") == (True, "beater") and two.judge("beafer", "", "") == (True, "heater")


def test_any_number_of_confusions():
    glyphs = sr.Glyphs({"settlement": 50}, {}, 3)
    assert glyphs.judge("scfflcmcnf") == (True, "settlement")
    assert sr.read_from("cornrnon", "common") and not sr.read_from("eat", "cat")
