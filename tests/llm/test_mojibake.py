"""Problem 10 by round trips: damage known texts, find and restore them."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm.mojibake import _MAX_PIECE, _TOKEN, LOST, TOKEN, damaged_documents, pieces_of, quoted_only, replaced, restored_documents

CLEAN = [
    "Ángelo Núñovar voló después del partido en Québrou; según el pronóstico, mañana será más fácil.",
    "L’équipe a frappé 5 coups sûrs et volé un but à l’approche du premier lancer, à Fort Élanne.",
    "Für Zürnbach wird böiger Südwestwind erwartet. „Wir müssen früher Druck machen“, erklärte Drüskenau.",
    "MANHÃ DE DECISÃO: AÇÃO E EMOÇÃO ATÉ A ÚLTIMA ENTRADA. A cotação não mudou até a confirmação da escalação.",
    "It wasn’t played — “we just kept the line moving,” he said after the 8–4 win. There’s no edge left.",
    "予報によると風は左翼方向へ毎時マイルで吹く。市場価格は試合前に上昇した。",
]
QUOTING = ["The importer log shows the sequence “Ã©” where the feed had an accent.", 'Anyone who meets "â€™" in a title should report it.']


def utf8_as(text, reading):
    return "".join(bytes([b]).decode(reading, "replace") if reading != "cp1252" or b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in text.encode("utf-8"))


DAMAGED = {
    100: utf8_as(CLEAN[0], "cp1252"), 101: utf8_as(CLEAN[1], "latin-1"), 102: utf8_as(CLEAN[2], "mac_roman"), 103: utf8_as(CLEAN[3], "cp437"),
    104: utf8_as(utf8_as(CLEAN[4], "cp1252"), "cp1252"), 105: utf8_as(CLEAN[5], "cp1252"), 106: utf8_as(CLEAN[0], "cp1251"),
    107: CLEAN[1].encode("cp1252").decode("mac_roman"), 108: CLEAN[2].replace("ü", LOST), 109: CLEAN[4].replace("wasn’t", "wasnâ€™t"),
}


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(10 * i + k + 1000, t) for k, t in enumerate(CLEAN) for i in range(12)]
    rows += [(500 + i, t) for i, t in enumerate(QUOTING)] + list(DAMAGED.items()) + [(900, None), (901, ""), (100, DAMAGED[100])]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_found(documents):
    got = [r.doc_id for r in damaged_documents(documents).collect()]
    assert sorted(got) == sorted(DAMAGED)


def test_restored(documents):
    got = {r.doc_id: r for r in restored_documents(documents).collect()}
    for doc, clean in ((100, 0), (101, 1), (102, 2), (103, 3), (104, 4), (105, 5), (106, 0), (107, 1), (108, 2), (109, 4)):
        assert got[doc].text == CLEAN[clean], doc


def test_quotes():
    assert quoted_only("“Ã©”") and quoted_only('"â€™"')
    assert not quoted_only("“Ã©t") and not quoted_only("“caféÃ©”") and not quoted_only("”")


def test_empty_and_long(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert damaged_documents(none).count() == 0
    long = spark.createDataFrame([(1, "é" * 30_000), (2, "plain " * 50_000)], "doc_id long, text string")
    assert damaged_documents(long).count() == 0


def test_copies_hide_nothing(spark):
    clean = [(i, f"{t} ({i})") for i in range(60) for t in CLEAN[:1]]
    odd = utf8_as("Ángelo Núñovar voló después del partido, según el pronóstico.", "cp1252")
    copies = [(1000 + i, odd) for i in range(3000)]
    got = {r.doc_id for r in damaged_documents(spark.createDataFrame(clean + copies, "doc_id long, text string")).collect()}
    assert got == {i for i, _ in copies}
    near = [(1000 + i, f"después {i}".encode().decode("cp1252")) for i in range(300)]  # each text its own, one damaged word in all
    frame = spark.createDataFrame(clean + near, "doc_id long, text string")
    assert {r.doc_id for r in damaged_documents(frame).collect()} == {i for i, _ in near}


def test_lost_places_in_a_large_alphabet(spark):
    signs = [chr(c) for c in range(0x4E00, 0x4E00 + 500)]  # 500 letters, each in more than five texts
    words = ["pronóstico", "Núñovár"]
    rows = [(i, f"{' '.join(words)} {' '.join(signs)} ({i})") for i in range(12)]
    rows += [(100, f"pron{LOST}stico"), (101, f"N{LOST}{LOST}ov{LOST}r"), (102, f"pron{LOST}stica"), (103, "pronÃstico")]
    got = {r.doc_id: r.text for r in restored_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {100: words[0], 101: words[1], 102: f"pron{LOST}stica", 103: words[0]}


def test_long_tokens_are_cut_at_safe_borders(spark):
    token = "a" * (_MAX_PIECE - 1) + "Ã©" + "b" * 3000
    assert "".join(pieces_of(token)) == token and not any(p.endswith("Ã") for p in pieces_of(token))
    odd = "x" * 2500 + "é"
    rows = [(i, odd + f" ({i})") for i in range(12)] + [(50, "x" * 2500 + LOST), (51, "x" * 2500 + "Ž")]
    got = {r.doc_id: r.text for r in restored_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {50: odd, 51: odd}


def test_healthy_parts_stay():
    assert replaced("x Ã©, “Ã©” and Ã©t", {"Ã©": "é"}) == "x é, “Ã©” and Ã©t"
    assert replaced("a\xa0Ã© \xa0b", {"Ã©": "é"}) == "a\xa0é \xa0b"
    assert replaced("plain", {"Ã©": "é"}) == "plain" and replaced("", {}) == ""


def test_workers_see_the_same_tokens(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("aZé Ã©\xa0“”\"'(7)-日", k=60)) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.regexp_extract_all("t", F.lit(TOKEN), F.lit(0)).alias("k"), "t").collect()
    assert all(r.k == [m.group() for m in _TOKEN.finditer(r.t)] for r in got)


def test_quotation_beside_damage(spark):
    clean = [(i, f"Perché é così, disse é ({i})") for i in range(40)]
    odd = [(100, "PerchÃ© Ã© cosÃ¬, disse; the note quotes “Ã©” as is")]
    got = {r.doc_id: r.text for r in restored_documents(spark.createDataFrame(clean + odd, "doc_id long, text string")).collect()}
    assert got == {100: "Perché é così, disse; the note quotes “Ã©” as is"}


def test_share_restored(spark):
    """Held-out accuracy: distinct texts damaged whole, each by one of four readings."""
    rng, readings = random.Random(5), ("cp1252", "latin-1", "mac_roman", "cp437")
    words = sorted({w for t in CLEAN[:5] for w in t.split()})
    texts = {1000 + i: " ".join(rng.choices(words, k=25)) for i in range(200)}
    odd = {5000 + i: utf8_as(" ".join(rng.choices(words, k=25)), rng.choice(readings)) for i in range(60)}
    rng = random.Random(5)
    for _ in range(200):
        rng.choices(words, k=25)
    want = {}
    for i in range(60):
        want[5000 + i] = " ".join(rng.choices(words, k=25))
        rng.choice(readings)
    got = {r.doc_id: r.text for r in restored_documents(spark.createDataFrame(list({**texts, **odd}.items()), "doc_id long, text string")).collect()}
    assert sum(got.get(k) == t for k, t in want.items()) >= 0.95 * len(want) and not set(got) & set(texts)
