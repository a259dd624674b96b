import random

from paperloom.llm import scan_repair as sr


def document(heads, pages):
    rng = random.Random(6)
    words = lambda: " ".join("".join(rng.choice("adgkmopstuwxz") for _ in range(9)) for _ in range(5))
    return {p: [*heads.get(p, []), *(words() for _ in range(8))] for p in range(1, pages + 1)}


def test_three_pages_suffice_in_long_documents():
    found = sr.edge_noise(document({p: ["Schedule of Rates"] for p in (20, 21, 22)}, 60))
    assert found == {(p, 0): "running" for p in (20, 21, 22)}
    assert sr.edge_noise(document({p: ["Schedule of Rates"] for p in (20, 21)}, 60)) == {}


def test_third_line_of_a_header():
    head = ["Bonvar Limited", "Strictly private", "Draft for comment"]
    assert sr.edge_noise(document({p: head for p in range(1, 5)}, 4)) == {(p, k): "running" for p in range(1, 5) for k in range(3)}
