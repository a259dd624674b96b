import math
import random

from paperloom.operators import packed_values as pv

NAMES = ["Bon & Sons Hardware Ltd.", "Mara Optics, Inc.", "Kel and Tovin Foundry GmbH", "Ada Pell", "Rudd (Milling) S.A.", "Pell, Ada", "Corvan Freight LLC", "Tovin Textiles Ltd.", "Kelbo Optics Inc.", "Jon Marrow"]


def split(rows, spark, rounds=2):
    df = spark.createDataFrame(rows, "id string, packed string, pos string")
    out = {}
    for r in pv.split_values(df, "id", "packed", rounds).orderBy("id", "pos").collect():
        out.setdefault(r.id, []).append(r.value)
        assert r.pos == len(out[r.id])
    return out


def fixture():
    rng = random.Random(4)
    rows, want = [], {}
    packers = ["; ".join, " | ".join, "\t".join, "\n".join, lambda v: ",".join(f'"{x}"' for x in v), " • ".join, lambda v: "\n".join(f"{n}. {x}" for n, x in enumerate(v, 1)), lambda v: " ".join(f"({n}) {x}" for n, x in enumerate(v, 1)), lambda v: '["' + '", "'.join(v) + '"]']
    for n in range(300):
        values = rng.sample(NAMES, rng.randrange(2, 4))
        rows.append((f"c{n}", rng.choice(packers)(values), "x"))
        want[f"c{n}"] = values
    for n, joiner in enumerate([", ", " and ", " & ", ", and "] * 10):
        values = [rng.choice(["Corvan Freight LLC", "Tovin Textiles Ltd.", "Kelbo Optics Inc."]), "Jon Marrow"]
        rows.append((f"d{n}", joiner.join(values), "x"))
        want[f"d{n}"] = values
    return rows, want


def test_round_trip_of_all_packings(spark):
    rows, want = fixture()
    assert split(rows, spark) == want


def test_edges(spark):
    rows = [
        ("a", None, "x"), ("b", "", "x"), ("c", " ;; ; ", "x"), ("d", "; One LLC ;; Two LLC;", "x"), ("d", "; One LLC ;; Two LLC;", "y"),
        ("e", 'One LLC, ("Buyer"); Two LLC (a company of Kestle; "Seller") (each a "Party"; collectively, the "Parties")', "x"),
        ("f", '"He said ""x"" Ltd.","Two LLC"', "x"), ("g", "by and between One LLC; and Two LLC", "x"), ("h", "One LLC<br>Two LLC", "x"),
    ]
    got = split(rows, spark)
    assert got == {"d": ["One LLC", "Two LLC"], "e": ["One LLC", "Two LLC"], "f": ['He said "x" Ltd.', "Two LLC"], "g": ["One LLC", "Two LLC"], "h": ["One LLC", "Two LLC"]}
    assert split(rows[:0], spark) == {}


def test_very_long_field(spark):
    values = [f"Name{n} LLC" for n in range(3000)]
    assert split([("z", ", ".join(values), "x")] + [(f"y{n}", f"A{n} LLC; B{n} LLC", "x") for n in range(20)], spark)["z"] == values


def test_best_path_equals_enumeration():
    rng = random.Random(9)
    model = pv.Model(total=100, ends={"llc": 40, "ltd": 20}, rare_ends=40)
    for (e, n, j, c), k in {("llc", 2, False, False): 30, ("ltd", 2, False, False): 20, ("?", 2, False, False): 30, ("llc", 4, True, False): 5}.items():
        model.sizes[e, n, j, c] += k
        model.kind_sizes["?" if e == "?" else "known", n, j, c] += k
    for _ in range(60):
        segment = "".join(rng.choice(["Aa", "Bb llc", "Cc Dd", "Ee ltd"]) + rng.choice([", ", " and ", " & "]) for _ in range(4)) + "Zz llc"
        cuts, values = pv.spans(segment)
        best = None
        for mask in range(1 << len(cuts)):
            at = [0, *(k + 1 for k in range(len(cuts)) if mask >> k & 1), len(cuts) + 1]
            score = sum(model.log_value(values[i, j], 0) for i, j in zip(at, at[1:]))
            score += sum(model.log_cut(c[2], False, bool(mask >> k & 1)) for k, c in enumerate(cuts))
            if best is None or score > best[0] + 1e-9:
                best = (score, [values[i, j] for i, j in zip(at, at[1:])])
        got = pv.best_path(segment, False, model, {})[0]
        assert abs(sum(model.log_value(v, 0) for v in got) - sum(model.log_value(v, 0) for v in best[1])) < 1e-6 or got == best[1]


def test_quoted_spans_stay_as_they_stand(spark):
    rows = [("a", '"Acme Bank (Ireland)", "And Co", "1) Alpha"', "x"), ("b", "Acme Holdings (UK); Beta Freight (BF)", "x"), ("c", '["the Bank (\\"Bank\\")", "B"]', "x")]
    got = split(rows, spark)
    assert got == {"a": ["Acme Bank (Ireland)", "And Co", "1) Alpha"], "b": ["Acme Holdings (UK)", "Beta Freight"], "c": ['the Bank ("Bank")', "B"]}


def test_values_of_many_delimiters(spark):
    firm = "Ames, Bode, Cole, Dorn, Eads, Finn & Gray LLP"
    rows = [(f"q{n}", f'"{firm}", "Name{n} LLC"', "x") for n in range(40)] + [(f"s{n}", f"Name{n} LLC; Item{n} LLC", "x") for n in range(40)] + [("z", firm, "x")]
    assert split(rows, spark)["z"] == [firm]


def test_expectations_equal_enumeration():
    rng = random.Random(3)
    model = pv.Model(total=100, ends={"llc": 40, "ltd": 20}, rare_ends=40)
    for (e, n, j, c), k in {("llc", 2, False, False): 30, ("ltd", 2, False, False): 20, ("?", 2, False, False): 30, ("llc", 4, True, False): 5}.items():
        model.sizes[e, n, j, c] += k
        model.kind_sizes["?" if e == "?" else "known", n, j, c] += k
    for _ in range(20):
        segment = "".join(rng.choice(["Aa", "Bb llc", "Cc Dd", "Ee ltd"]) + rng.choice([", ", " and ", " & "]) for _ in range(4)) + "Zz llc"
        cuts, values = pv.spans(segment)
        ways = []
        for mask in range(1 << len(cuts)):
            at = [0, *(k + 1 for k in range(len(cuts)) if mask >> k & 1), len(cuts) + 1]
            ways.append((sum(model.log_value(values[e], 0) for e in zip(at, at[1:])) + sum(model.log_cut(c[2], False, bool(mask >> k & 1)) for k, c in enumerate(cuts)), mask))
        total, _, fates = pv.expectations(segment, False, model, {})
        top = max(w for w, _ in ways)
        each = {m: math.exp(w - top) for w, m in ways}
        assert abs(total - top - math.log(sum(each.values()))) < 1e-6
        for k in range(len(cuts)):
            want = sum(p for m, p in each.items() if m >> k & 1) / sum(each.values())
            assert abs(fates[2 * k][3] - want) < 1e-6
