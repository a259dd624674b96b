import random

from paperloom.llm import name_links as nl
from paperloom.llm.names_lexicon import CALLED


def test_names_that_fit_share_a_key():
    rng = random.Random(3)
    names = [*CALLED, *"abcdefghij", "", "jane", "priya", "zorb", "zorby", "zorbie"]
    names += ["".join(rng.sample(n, len(n))) if rng.random() < 0.2 else n[: (k := rng.randrange(len(n)))] + rng.choice(["", "x", n[k]]) + n[k + 1 :] for n in rng.choices(list(CALLED), k=300)]
    for a in names:
        for b in rng.sample(names, 150):
            if nl.given_fits(a, b):
                assert nl.given_keys(a) & nl.given_keys(b), (a, b)


def test_swaps_share_a_key():
    for a, b in (("nroa", "nora"), ("prya", "priya"), ("prijya", "priya"), ("prixa", "priya")):
        assert not nl.given_fits(a, b) or nl.given_keys(a) & nl.given_keys(b)


def test_large_families_are_linked_by_given_name(spark):
    names = [f"{g} Kadmulson" for g in ("Nora", "Robert", "Bob", "R.", "William", "Bill", "Will")] + [f"Qz{chr(97 + k)}{chr(97 + n)}xw Kadmulson" for k in range(20) for n in range(20)]
    got = {}
    for r in nl.parties(spark.createDataFrame([(n,) for n in names], "name string")).collect():
        got.setdefault(r.party, set()).add(r.name)
    assert {"Robert Kadmulson", "Bob Kadmulson", "R. Kadmulson"} in got.values() and {"William Kadmulson", "Bill Kadmulson", "Will Kadmulson"} in got.values()
