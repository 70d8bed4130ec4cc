import random

import pytest

from hydrostrata.llm import mojibake

CLEAN = ["जोयेबुगढ़", "तिपेकोट्टै", "கோதேகோகேட்", "São Tajosi", "Assunção Nova", "Bādūhāllī", "Kulôlaganj", "Hapija’s Tank", "Kitodô – West", "Vibüpalli", "Rávesar", "LUHIKUND (लुहिकुंड)"]
ODD = ["PÂRBO", "Derigaon (Â)", "SÃO NORO", "ÇÔTE RUTA", "№3 KINO", "« Old » X", "15°N", "½ MILE", "4×2", "BEHUNE??", "ÑDosami", "", "  ", "plain"]


def garble(name, page):
    table = {}
    for b in range(256):
        try:
            table[b] = bytes([b]).decode(page)
        except UnicodeDecodeError:
            table[b] = chr(b)
    return "".join(table[b] for b in name.encode())


@pytest.fixture(scope="module")
def result(spark):
    draw = random.Random(3)
    rows = [("districts", f"c{i}", n) for i, n in enumerate((CLEAN + ODD) * 15)] + [("districts", "null", None)]
    wrong = {}
    for i in range(200):
        name, page = draw.choice(CLEAN), draw.choice(("cp1252", "latin-1", "mac_roman", "cp437", "cp1251"))
        wrong[f"g{i}"] = (garble(name, page), name)
    wrong["twice"] = (garble(garble("São Tajosi", "cp1252"), "cp1252"), "São Tajosi")
    wrong["wide"] = ("LITEGIRI".encode().decode("utf-16-le"), "LITEGIRI")
    rows += [("districts", k, g) for k, (g, _) in wrong.items()] + [("districts", "lost", "S�o Tajosi"), ("districts", "part", "LUHIKUND " + garble("(लुहिकुंड)", "cp1252"))]
    names = spark.createDataFrame([(*r, "clash") for r in rows], "table_name string, record_id string, name string, source string")
    usable = names.where("name is not null").select("table_name", "record_id", "name")
    model = mojibake.fit(usable.select("name"))
    return wrong, {r.record_id: r for r in mojibake.garbled(usable, "name", model).collect()}


def test_garbled_names_are_found_and_clean_ones_are_not(result):
    wrong, got = result
    assert set(got) == set(wrong) | {"lost", "part"}


def test_restored(result):
    wrong, got = result
    assert not [(g, name, got[k].restored, got[k].source) for k, (g, name) in wrong.items() if got[k].restored != name]
    assert got["lost"].restored == "São Tajosi" and got["part"].restored == "LUHIKUND (लुहिकुंड)"


def test_cut_letters_are_not_restored(spark, result):
    name = garble("கோதேகோகேட்", "latin-1")
    cut = "".join(c for c in name if not 0x80 <= ord(c) < 0xA0)
    df = spark.createDataFrame([("d", "x", cut)], "table_name string, record_id string, name string")
    model = mojibake.fit(spark.createDataFrame([(n,) for n in CLEAN * 20], "name string").unionByName(df.select("name")))
    row = mojibake.garbled(df, "name", model).first()
    assert row is not None and row.restored is None


def test_what_names_say_replaces_the_published_entry(spark):
    # a page like cp1252 but for one symbol, which that page does not have at all
    swapped = [garble(n, "cp1252").replace("¤", "₪") for n in CLEAN for _ in range(20)]
    names = [n for n in CLEAN for _ in range(30)] + [garble(n, "cp1252") for n in CLEAN for _ in range(2)] + swapped
    assert "₪" not in mojibake.page_table("cp1252")
    model = mojibake.fit(spark.createDataFrame([(n,) for n in names], "name string"))
    assert any(t.get("₪") == 0xA4 for t in model.ciphers.values())


@pytest.mark.parametrize("page, pages", [("mac_latin2", mojibake.PAGES), ("cp1256", mojibake.PAGES), ("cp1252", ())])
def test_a_page_that_nothing_is_known_of_is_learnt(spark, page, pages):
    assert page not in pages
    tables = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet").selectExpr(f"{c} AS name") for t, c in (("districts", "district_name"), ("assessment_units", "unit_name")))
    real = [r[0] for r in next(tables).union(next(tables)).where("name is not null").distinct().orderBy("name").collect()]
    draw = random.Random(8)
    draw.shuffle(real)
    sound = [n for n in real if not mojibake._suspect(n, mojibake._initial(mojibake.PAGES))]
    other = [n for n in sound if not n.isascii()]
    clean = [n for n in sound if n.isascii()][:5000] + other[400:] + ODD
    wrong = {garble(n, page): n for n in other[:400]}
    names = [*clean, *wrong]
    model = mojibake.fit(spark.createDataFrame([(n,) for n in names], "name string"), pages=pages)
    truth = mojibake.page_table(page)
    # entries that no table given before has
    fresh_symbols = {c: b for c, b in truth.items() if all(mojibake.page_table(p).get(c) != b for p in pages)}
    shown = mojibake.Counter(c for g in wrong for c in g if c in fresh_symbols)
    table = max(model.ciphers.values(), key=lambda t: sum(n for c, n in shown.items() if t.get(c) == truth[c]))
    assert sum(n for c, n in shown.items() if table.get(c) == truth[c]) >= 0.95 * shown.total() > 0
    assert {c: table.get(c) for c, b in truth.items() if b in (0xE0, 0xA4, 0xA5)} == {c: b for c, b in truth.items() if b in (0xE0, 0xA4, 0xA5)}
    rows = spark.createDataFrame([("d", str(i), n) for i, n in enumerate(names)], "table_name string, record_id string, name string")
    got = {r.name: r.restored for r in mojibake.garbled(rows, "name", model).collect()}
    assert not set(got) & set(clean) and len(set(wrong) & set(got)) >= 0.93 * len(wrong)
    assert sum(got.get(g) == n for g, n in wrong.items()) >= 0.75 * len(wrong)


def test_forward_backward_counts_what_enumeration_counts():
    model = mojibake.Model(mojibake._bigrams([("सर", 3), ("éa", 2), ("रस", 1), ("ésर", 1)]).astype(float), {}, {})
    letters, symbols = "éरस", "abcdef"
    table = mojibake.np.random.default_rng(1).random((128, 6))
    reader = mojibake.Decipherer(model, letters, symbols, table)
    for run in ("ab", "abc", "abcde", "fedcbabc", "abababababab"):
        counts = mojibake.np.zeros((128, 6))
        log = reader.read("^", run, "$", counts)
        wanted, total = mojibake.np.zeros((128, 6)), 0.0

        def spell(at, text, p, run=run):
            nonlocal wanted, total
            if at == len(run):
                p *= mojibake.np.exp(model.chance(text[-1], "$"))
                total += p
                for b, s in zip(text[1:].encode(), run, strict=True):
                    wanted[b - 0x80, symbols.index(s)] += p
                return
            for c in letters:
                code = c.encode()
                if at + len(code) <= len(run):
                    q = p * mojibake.np.exp(model.chance(text[-1], c))
                    for j, b in enumerate(code):
                        q *= table[b - 0x80, symbols.index(run[at + j])]
                    spell(at + len(code), text + c, q)

        spell(0, "^", 1.0)
        assert log == pytest.approx(mojibake.np.log(total)) and counts == pytest.approx(wanted / total, abs=1e-9)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "district_id string, district_name string")
    u = spark.createDataFrame([], "unit_id string, unit_name string")
    assert mojibake.garbled_names(d, u).count() == 0
