import random

from paperloom.llm import personal_data as pd

TEXT = (
    "Contact: Nora Q. Veltanpol, tel. +1 604 555 0186, e-mail nora.velt [at] mail [dot] pol [dot] test. Signed by Veltanpol, Nora; SSN 666-12-3456; "
    "Flat 6, 593 Almond Ave., Apt 2C\nwrite to A.BC@XY.EXAMPLE or call (07700) 900165. S. Futhiten lives at 12 rue des Ormes, Kestle. "
    "Order 4500-88-2290 ships on 11.03.2023 from Robert & Daughters Ltd. to Calle Olmo 117; Larkmoor Street Fund; passport C46G2864V; identity card 19458458-A; "
    "GERALD KADMUL, Hubertweg 5, 001-659-555-0124 ext. 9; contract no. 2025-07-2517"
)
WANT = [
    ("person", "Nora Q. Veltanpol"), ("phone", "+1 604 555 0186"), ("email", "nora.velt [at] mail [dot] pol [dot] test"), ("person", "Veltanpol, Nora"), ("id_number", "666-12-3456"),
    ("street_address", "Flat 6, 593 Almond Ave., Apt 2C"), ("email", "A.BC@XY.EXAMPLE"), ("phone", "(07700) 900165"), ("person", "S. Futhiten"), ("street_address", "12 rue des Ormes"),
    ("street_address", "Calle Olmo 117"), ("id_number", "C46G2864V"), ("id_number", "19458458-A"), ("person", "GERALD KADMUL"), ("street_address", "Hubertweg 5"), ("phone", "001-659-555-0124 ext. 9"),
]


def test_mentions():
    assert [(k, TEXT[a:b]) for a, b, k in pd.mentions(TEXT)] == WANT
    assert pd.mentions(None) == pd.mentions("") == pd.mentions(" \n") == []
    assert pd.mentions("x" * 200_000) == []


def test_forms_keep_kind_case_and_punctuation():
    key = b"k"
    for kind, value in WANT:
        new = pd.in_form(kind, value, pd.replacement(key, kind, pd.identity(kind, value), 0))
        assert new != value and value.isupper() == new.isupper()
        if kind in ("phone", "id_number"):
            assert [c for c in new if not c.isalnum()] == [c for c in value if not c.isalnum()] and len(new) == len(value)
    a = pd.replacement(key, "person", pd.identity("person", "Nora Q. Veltanpol"), 0)
    assert pd.identity("person", "Veltanpol, Nora") == pd.identity("person", "NORA VELTANPOL")
    assert a.split()[0] in pd.FEMALE
    assert pd.in_form("person", "Veltanpol, Nora", a) == f"{a.split()[1]}, {a.split()[0]}"


def test_surrogates_are_distinct_and_not_real(spark, monkeypatch):
    real = pd.replacement
    # a small range forces collisions, also with real entities
    monkeypatch.setattr(pd, "replacement", lambda key, kind, entity, attempt: f"e{pd.draw(key, kind, entity, attempt) % 90}")
    monkeypatch.setattr(pd, "identity", lambda kind, value: value)
    df = spark.createDataFrame([("person", f"e{n}") for n in range(0, 30)] + [("person", "e1")], "pii_kind string, entity string")
    got = pd.surrogates(df, b"k", rounds=60).collect()
    assert len(got) == 30 and len({r.surrogate for r in got}) == 30
    assert not {r.surrogate for r in got} & {r.entity for r in got}
    assert real is not pd.replacement


def test_replaced(spark):
    rows = [(1, TEXT, 9), (2, None, 9), (3, "", 9), (4, "nothing here", 9), (1, TEXT, 9), (5, "Nora Veltanpol wrote.", 9)]
    df = spark.createDataFrame(rows, "message_id bigint, content string, entity int")
    got = {r.message_id: r for r in pd.replaced(df, "message_id", "content", b"k").collect()}
    assert len(got) == 5 and got[2].placeholders is None and got[3].placeholders == "" and got[4].surrogates == "nothing here"
    for _, value in WANT:
        assert value not in got[1].surrogates and value not in got[1].placeholders
    assert [k for *_, k in pd.mentions(got[1].surrogates)].count("phone") == 3
    tag = got[5].placeholders.split()[0]
    assert tag.startswith("[PERSON-") and got[1].placeholders.count(tag) == 2
    found = pd.find_mentions(df, "message_id", "content").where("message_id = 1").distinct().count()
    assert found == len(WANT)
    assert pd.replaced(df.limit(0), "message_id", "content", b"k").count() == 0


def test_random_text_spans_are_in_order():
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice(["Nora ", "Kadmul, ", "+1 ", "555", "-", "01", " ", "a@b.co", "S. ", "12 ", "Road", "\n", "é", "😀"]) for _ in range(40))
        m = pd.mentions(t)
        assert all(a < b for a, b, _ in m) and all(x[1] <= y[0] for x, y in zip(m, m[1:]))


def entities(text):
    return [e for e, (_, _, k) in zip(pd.entities(text, pd.mentions(text)), pd.mentions(text)) if k == "person"]


def test_people_are_told_apart_and_kept_together():
    assert len(set(entities("Rick Smith met Fred Smith."))) == 2
    assert entities("Rick Smith is Richard Smith.") == ["richard smith"] * 2
    assert len(set(entities("Harry Hill met Harold Hill and Henry Hill."))) == 3
    assert entities("John Smith signed. J. Smith left.") == ["john smith"] * 2
    assert entities("John Smith, James Smith and J. Smith")[-1] == "j smith"
    assert entities("Bob Marrow and Robert Marrow") == ["robert marrow"] * 2
    assert entities("Alex Roe is Alexandra Roe") == ["alexandra roe"] * 2
    assert pd.identity("person", "Dr Chris Poe") == pd.identity("person", "Chris Poe")


def test_generator_is_distinct_for_many_entities():
    seen = [set(), set(), set()]
    for n in range(200_000):
        for kind, told in zip(("person", "street_address", "email"), seen):
            # what a round leaves for the next is a small share, and ranges grow with rounds
            told.add(pd.replacement(b"k", kind, f"anna name{n}" if kind == "person" else f"{n}", 3).split(" ", 1)[-1])
    assert [len(s) for s in seen][0] > 199_000 and len(seen[2]) == 200_000 and len(seen[1]) > 190_000
    numbers = {pd.replacement(b"k", "id_number", f"{n:09d}", pd.FORMAT_ROUNDS + 5) for n in range(20_000)}
    assert len(numbers) > 19_990 and all(len(x) == 14 for x in numbers)


def test_hot_entities_meet_in_parts(spark, monkeypatch):
    monkeypatch.setattr(pd, "PART", 10)
    rows = [(n, 0, 9, "email", "a@b.co", "a@b.co") for n in range(95)] + [(100, 3, 5, "email", "c@d.co", "c@d.co")]
    found = spark.createDataFrame(rows, "id int, start_pos int, end_pos int, pii_kind string, mention string, entity string")
    made = spark.createDataFrame([("email", "a@b.co", "x"), ("email", "c@d.co", "y")], "pii_kind string, entity string, surrogate string")
    got = pd.with_surrogates(found, made).collect()
    assert len(got) == 96 and {(r.entity, r.surrogate) for r in got} == {("a@b.co", "x"), ("c@d.co", "y")}
