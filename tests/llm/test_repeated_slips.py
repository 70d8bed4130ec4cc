import random

from hydrostrata.llm import crosssplit as cs

SCHEMA = "id string, split string, language string, intent string, question string, entities array<struct<type string, db_name string, display string>>, columns array<string>"


def test_copies_of_a_slip_make_no_name(spark):
    draw = random.Random(3)
    name = lambda: "".join(draw.choice("kgmnptdl") + draw.choice("aeiou") for _ in range(4)).title() + "pur"
    ask = "How much rainfall was noted for {} during {}?"
    cycles = ["2016-2017", "2019-2020", "2021-2022", "2022-2023", "2023-2024"]
    names = [name() for _ in range(60)] + ["Rudogapur", "Rudogapul"]
    rows = [(f"t{i}.{c[:4]}", "train", "english", "value", ask.format(p, c), [("unit", p.upper(), p)], ["rain_mm"]) for i, p in enumerate(names) for c in cycles]
    slip = names[0][:3] + names[0][4:]
    rows += [(f"e{k}", "test", "english", "value", ask.format(slip, cycles[0]), None, None) for k in range(8)]
    rows += [("n1", "dev", "english", "value", ask.format("Rudogapul", cycles[1]), None, None)]
    got = {(r.train_id, r.eval_id) for r in cs.overlaps(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("t0.2016", f"e{k}") for k in range(8)} | {("t61.2019", "n1")}
