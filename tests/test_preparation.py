"""Blocks, windows, cut code, repaired layout, legibility, and files of rows and records: known cases and brute force."""

import json
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvine.functions.quality import assess, clean_token, is_noise, is_unstable
from corvine.operators import blocks, code, layout, records
from corvine.plans import preparation
from corvine.sources import delimited, streams

# ---- blocks and windows

TABLE = "# people\n\n| Name | Value |\n| --- | --- |\n| Alice | 42 |\n| Bob \\| Co | 7 |\n"


def test_rows_of_a_table_stand_for_it():
    found = blocks.prepare(TABLE)
    assert [(b[0], b[6]) for b in found] == [
        ("heading", "people"), ("table", "| Name | Value |\n| --- | --- |\n| Alice | 42 |\n| Bob \\| Co | 7 |"),
        ("table_row", "Sheet: people | Row 1 | Name: Alice | Value: 42"), ("table_row", "Sheet: people | Row 2 | Name: Bob | Co | Value: 7"),
    ]
    assert [[b[1] for b in w] for w in blocks.windows(found)] == [["people"], ["| Alice | 42 |"], ["| Bob \\| Co | 7 |"]]


def test_kinds_that_stand_alone_and_headings():
    unit = lambda k, t: (k, t, [], 0, False)
    found = blocks.windows([unit("source_profile", "p"), unit("source_unit", "a"), unit("source_unit", "b")])
    assert [[b[1] for b in w] for w in found] == [["p"], ["a"], ["b"]]
    both = blocks.windows([unit("heading", "API"), unit("endpoint_block", "GET /v1/accounts")], 80, 0)
    assert len(both) == 1 and blocks.dominant_kind([b[0] for b in both[0]]) == "endpoint_block"
    rows = [unit("paragraph", "x" * 40), unit("heading", "H"), unit("paragraph", "y" * 40)]
    assert len(blocks.windows(rows, 100, 0)) == 2 and len(blocks.windows(rows, 200, 0)) == 1


def brute_windows(rows, most, overlap):
    """Window by window from indexes: what is kept, where each begins and ends."""
    has_rows = [b[0] == "table" and i + 1 < len(rows) and rows[i + 1][0] == "table_row" for i, b in enumerate(rows)]
    kept = [b for b, t in zip(rows, has_rows, strict=True) if not b[4] and not t and b[6].strip()]
    cost = lambda part: sum(len(b[6].strip()) for b in part) + 2 * max(0, len(part) - 1)
    out, start, i = [], 0, 0
    for i, b in enumerate(kept):
        if b[0] in blocks.STANDALONE:
            out += [kept[start:i]] * (start < i) + [[b]]
            start = i + 1
        elif start < i and (cost(kept[start : i + 1]) > most or (b[0] == "heading" and cost(kept[start:i]) >= most // 3)):
            out.append(kept[start:i])
            back = i
            while back > start and cost(kept[back - 1 : i]) <= overlap:
                back -= 1
            start = back if cost(kept[back : i + 1]) <= most else i
    return out + ([kept[start:]] if start < len(kept) else [])


def test_windows_of_all_pages(spark, sf):
    """Every page has blocks of all sorts; windows are those of a plain scan, and their texts, digests and trails follow from them."""
    outlines = preparation.outlines(spark.read.parquet(f"{sf}/pages.parquet"))
    chunks = {(r.page_id, r.chunk_index): r for r in blocks.chunks(outlines, 900, 120, id_col="page_id").collect()}
    kinds, several, windowed = set(), 0, 0
    for r in outlines.collect():
        rows = blocks.split_code(blocks.prepare(r.text), 900)
        kinds |= {b[0] for b in rows}
        windows = brute_windows(rows, 900, 120)
        several += len(windows) > 3
        texts = ["\n\n".join(b[6].strip() for b in w) for w in windows]
        assert max(k for p, k in chunks if p == r.page_id) == len(windows) - 1
        for i, (w, t) in enumerate(zip(windows, texts, strict=True)):
            found = chunks[r.page_id, i]
            assert found.normalized_text == t and found.n_blocks == len(w) and found.token_count == len(t.split())
            assert len(t) <= 900 or len(w) == 1
            assert found.window_text == blocks.sentence_window(texts, i)
            windowed += found.window_text is not None
    assert {"heading", "paragraph", "table", "table_row", "list_item", "code_block"} <= kinds and several > 10 and windowed > 100


# ---- code


@pytest.mark.parametrize(
    "language, text, starts",
    [
        ("rust", "use std::fmt;\n/// About x\npub fn x() {}\nlet a = 1;\nimpl A {\n    fn y() {}\n}\n#[test]", [1, 2, 4, 5, 7]),
        ("py", "import a\n@cached\ndef f():\n    pass\n@property\nx = 1\nclass B:\n    async def g(self):", [1, 2, 6, 7]),
        ("go", "package main\ntype T struct {\ntype U = V\nfunc (t T) m() {", [0, 1, 3]),
        ("tsx", "export const f = async (x) => {\nconst g = (y) => 1\n  const h = (z) => 2\nexport type T = {", [0, 1, 3]),
        ("java", "import a.b;\npublic class C {\n  private int n = 3;\n  protected void m(int a) {\n  int k;", [0, 1, 3]),
        ("cpp", "#include <a>\nint main() {\n  call(x);\nif (a) {\nreturn f(x);\n// note (1)\nnamespace n {", [0, 1, 6]),
        ("shell", "# set up()\nrun() {\nfunction go\necho hi", [1, 2]),
        ("sql", "create table t (\n a int\n);\n-- === part\nselect 1;\nInsert Into t values (1);", [0, 3, 5]),
        ("yaml", "a:\n  b:\n# c:\n- d:\ne: 1\nf:", [0, 5]),
        ("toml", "[a]\nb = 1\n[[c]]", [0, 2]),
        ("r", "f <- function(x) {\ny = 2\n  g = function(z) z", [0, 2]),
        ("unknown", "def f():", []),
    ],
)
def test_definitions(language, text, starts):
    assert code.unit_starts(text.split("\n"), language) == starts


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["def f():", "    x = 1", "class A:", "", "    " + "y" * 30, "@d", "# é comment"]), max_size=30), st.integers(1, 60))
def test_pieces_keep_the_code(lines, most):
    text = "\n".join(lines)
    found = code.code_parts(text, "python", most)
    assert all(0 < len(p) <= most and p.strip() for p in found)
    assert "".join("".join(found).split()) == "".join(text.split())
    if max(map(len, lines), default=0) <= most:
        assert [x for p in found for x in p.split("\n") if x] == [x for x in lines if x]


def test_pieces_begin_at_definitions():
    text = "import a\n\ndef f():\n    return 1\n\nclass B:\n    x = 1\n    def g(self):\n        return 2\n"
    assert code.code_parts(text, "python", 40) == ["import a\n", "def f():\n    return 1\n", "class B:\n    x = 1", "    def g(self):\n        return 2"]
    assert code.code_parts("x = 1\ny = 2\nz = 3", "python", 11) == ["x = 1\ny = 2", "z = 3"]


def test_code_pieces_of_all_listings(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    texts = {r.p_partkey: r for r in preparation.listings(part).collect()}
    found = {}
    for r in code.code_pieces(preparation.listings(part), 90, "p_partkey", "text", "language").orderBy("p_partkey", "ordinal").collect():
        assert len(r.piece) <= 90 and r.language == texts[r.p_partkey].language
        found.setdefault(r.p_partkey, []).append(r.piece)
    assert found.keys() == texts.keys() and all(len(p) > 1 for p in found.values())
    assert all("".join("".join(p).split()) == "".join(texts[k].text.split()) for k, p in found.items())
    rows = spark.createDataFrame([(1, None, None), (2, " \n", "py"), (3, "def a():\n  1\ndef b():\n  2", "")], "doc_id int, text string, l string")
    assert [(r.doc_id, r.language, r.piece) for r in code.code_pieces(rows, 15, language_col="l").collect()] == [(3, "python", "def a():\n  1"), (3, "python", "def b():\n  2")]


def test_large_code_is_cut_before_windows():
    text = "```rust\n" + "\n\n".join(f"pub fn f{i}() {{\n    let x = {i};\n}}" for i in range(40)) + "\n```"
    found = blocks.split_code(blocks.prepare(text), 500)
    assert len(found) > 1 and all(b[0] == "code_block" and b[5] == "rust" and len(b[1]) <= 500 for b in found)


# ---- layout


def test_layout_cases():
    repaired = layout.repair("pageNu\nmber\nwithCar\nds\nnumber\n_starting\ninte\nger\nboo\nlean")[0]
    assert repaired.split() == ["pageNumber", "withCards", "number_starting", "integer", "boolean"]
    repaired = layout.repair("http\n://example.invalid:8080/records-api/rest/v1/items\n/bypage\n/system/info")[0]
    assert "http://example.invalid:8080/records-api/rest/v1/items/bypage" in repaired and "/system/info" in repaired
    assert layout.repair("REST\nAPI\nGET") == ("REST\nAPI\nGET", 0)
    assert "axis ax\nbeta " in layout.repair("axis ax\nbeta https://example.invalid/group/item.ext -p /tmp/item.ext")[0]
    repaired = layout.repair("axis axbeta https://example.invalid/group/item.ext -p /tmp/item.ext\nmark +x /tmp/item.ext/tmp/item.ext")[0]
    assert "axis ax beta " in repaired and "mark +x /tmp/item.ext /tmp/item.ext" in repaired
    prose = "A plain sentence of words,\nand another one that continues\nover some lines.\n\n- an item\n| a | b |"
    assert layout.repair(prose) == (prose, 0)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["pageNu", "mber", "http", "://a.b/c", "/d.e/f.g", "A", "The", "inte", "_x", "words,", "-p", "x=1", "ax", "axbeta"]), max_size=4).map(" ".join), max_size=8))
def test_layout_repair_loses_nothing(lines):
    text = "\n".join(lines)
    repaired, joined = layout.repair(text)
    assert "".join(repaired.split()) == "".join(text.split())
    filled = lambda t: sum(bool(x.strip()) for x in t.split("\n"))
    assert filled(repaired) == filled(text) - joined


def test_layout_of_all_documents(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    found = {r.doc_id: (r.text, r.joined) for r in layout.repair_layout(documents).collect()}
    assert found == {r.doc_id: layout.repair(r.text or "") for r in documents.collect()}
    assert sum(j for _, j in found.values()) < 0.05 * sum(t.count("\n") + 1 for t, _ in found.values())  # prose is left alone


# ---- legibility


def brute_tokens(token):
    """(unstable, noise) of a clean token, character by character."""
    script = lambda c: next((i for i, (a, b) in enumerate([(0, 0x24F), (0x370, 0x3FF), (0x400, 0x52F), (0x590, 0x5FF), (0x4E00, 0x9FFF)]) if a <= ord(c) <= b), 99) if c.isalpha() else None
    pairs = list(zip(token, token[1:], strict=False))
    turns = sum((a.islower() and b.isupper()) or (a.isupper() and b.islower()) for a, b in pairs)
    digit = lambda c: c in "0123456789"
    meets = sum(digit(a) != digit(b) and (a.isalpha() or b.isalpha()) for a, b in pairs)
    scripts = sum(script(a) is not None and script(b) is not None and script(a) != script(b) for a, b in pairs)
    letters, digits = sum(map(str.isalpha, token)), sum(map(digit, token))
    up, low = sum(map(str.isupper, token)), sum(map(str.islower, token))
    inner = any(len(m[0]) > 1 and m.start() > 0 for m in re.finditer("[" + "".join({re.escape(c) for c in token if c.isupper()} or {"\0"}) + "]+", token))
    stable = "://" in token or token.count("/") > 1 or token.count("_") > 1
    odd = (up and low and turns >= 3 and (inner or digits)) or (len(token) <= 5 and up >= 2 and low >= 2 and turns >= 3) or (digits and (meets or (up >= 2 and low >= 2))) or scripts >= 2 or (digits and not low and up >= 5)
    return bool(len(token) >= 4 and not stable and letters >= 4 and odd), bool(len(token) >= 4 and letters >= 3 and ((digits and meets) or scripts >= 2))


def test_tokens_against_brute_force(spark):
    words = "aBcD3eFgH getUserById renderHTMLNode abCD4efGH CTpoKe NODE_ALPHA-42 a_b_c1D2 http://A1b2 x/y/Z3z4 AB12CDE word Wort3 3dPrint éÉéÉ ñandú Enμα αaβbγ АbВc абвг 漢字かな ABCDE1 a1b2 ABc abCDef".split()
    documents = duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    words += sorted({w.strip(",.;:!?*#%&$\"'()") for (t,) in documents for w in (t or "").split()} - {""})[::7]
    rows = spark.createDataFrame([(w,) for w in words], "t string").select(clean_token(F.col("t")).alias("t")).select("t", is_unstable(F.col("t")).alias("u"), is_noise(F.col("t")).alias("n"))
    for r in rows.collect():
        assert (r.u, r.n) == brute_tokens(r.t), r.t


NOISE = "aBcD3eFgH qWeR7tYuI zXcV9bNmP lMnO4pQrS tUvW6xYzA"
CODE = "GET /v1/items status_code config.value key=value item[index] "


def test_legibility_cases(spark):
    cases = {
        "noise": NOISE,
        "context": "overview status project service alpha beta gamma delta abCDEfGHij klMNOqRStu uvWXYzABcd efGHIjKLmn",
        "regular": "summary topic alpha beta gamma abCD4efGH hiJKlmNO pQrST uvWXyZab cdEFGh3Ij klMNOprs tuVWxyZq mnOPqRst",
        "dominant": CODE * 2 + NOISE + " abCD4efGH hiJK5lmNO pQrST6uv wxYZ7abC klM8nOPq qrST9uvW xyZA1bcD efGH2ijK lmNO3pQr stUV4wXy",
        "prose": "Alpha service stores project settings and renders a concise operational summary.",
        "spanish": "El servicio almacena la configuración del proyecto y genera un resumen operativo.",
        "code": "POST /api/v1/projects getUserById setProjectOwner renderHTMLNode parseHTTPResponse AUTH_TOKEN_TIMEOUT_MS status_code",
        "short": "aB3dE �", "empty": "", "none": None,
        "replaced": "plain words with replaced characters " + "�" * 3, "control": "plain words with control characters " + "\x01" * 3,
        "wide": " ".join(["word"] * 52 + ["abCDefGHij"] * 8),
    }
    rows = spark.createDataFrame(list(cases.items()), "name string, text string").select("name", assess(F.col("text")).alias("q")).collect()
    found = {r.name: r.q for r in rows}
    assert {n for n, q in found.items() if q.low_confidence} == {"noise", "context", "regular", "dominant", "replaced", "control"}
    assert all(q.score <= 0.3 for q in found.values() if q.low_confidence) and all(q.score == 1 for n, q in found.items() if n in ("prose", "spanish", "short", "empty", "none"))
    assert found["noise"].unstable >= 4 and found["regular"].unstable >= 6 and found["dominant"].reasons == ["dominant_structural_noise"]
    assert found["replaced"].reasons == ["replacement_chars"] and found["control"].reasons == ["control_chars"]
    assert found["wide"].reasons == ["widespread_unstable_tokens"] and abs(found["wide"].score - (1 - 8 / 60 * 1.35)) < 1e-9


def test_illegible_chunks_fail_the_gate(spark):
    rows = spark.createDataFrame([(1, NOISE + " " + NOISE), (2, "A chunk of plain words that anyone can read, and that is long enough to count as a text of its own.")], "doc_id int, text string")
    assert [r.doc_id for r in blocks.chunks(rows).where("quality_score >= 0.35").collect()] == [2]


def test_near_duplicate_lines_by_brute_force(spark, sf):
    """An earlier line of the document with the same shingles votes alike, but has another digest."""
    from corvine import registry

    rows = registry.QUERIES["c10_simhash"](spark, sf).collect()
    fingerprint = {(r.doc_id, r.chunk_index): r.simhash for r in rows}
    found = {(r.doc_id, r.chunk_index): r.is_near_duplicate for r in registry.QUERIES["c11_near_duplicate_flag"](spark, sf).collect()}
    texts = {(d, i): t for d, text in duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall() for i, t in enumerate(text.split("\n")) if t.strip(" ")}
    assert found.keys() == fingerprint.keys() == texts.keys()
    first = {}
    for doc, i in sorted(texts):
        same = first.setdefault((doc, fingerprint[doc, i]), texts[doc, i])
        assert found[doc, i] == (same != texts[doc, i])
    cases = spark.createDataFrame([(1, 0, "One two  three four"), (1, 1, "one two three four"), (1, 2, "other words here now"), (1, 3, None)], "doc_id int, chunk_index int, content_text string")
    from corvine.functions.text import simhash

    votes = {r.chunk_index: r.simhash for r in simhash(cases, ["doc_id", "chunk_index"], "content_text").collect()}
    assert votes[0] == votes[1] != votes[2] and len(votes) == 4


# ---- files of rows


def test_delimiters():
    assert delimited.infer_delimiter("a|b|c\n1|2|3\n") == "|" and delimited.infer_delimiter("a\tb\n1\t2\n") == "\t"
    assert delimited.infer_delimiter('"x;y",b\n"p;q",d\n') == "," and delimited.infer_delimiter("a;b,c\n1;2,3\n") == ";"
    assert delimited.infer_delimiter("one\ntwo\n") == "|"  # all alike: the last candidate
    assert delimited.parse("﻿a,b\n\n1\n,,\n1,2,3\n")[1] == [["a", "b"], ["1"], ["1", "2", "3"]]


@pytest.mark.parametrize(
    "text, policy, headers, rows, caption",
    [
        ("Name,Email\nAlice,alice@example.com\nBob,bob@example.com\n", "inferred_first_row_header", ["Name", "Email"], 2, None),
        ("Welcome to File Extension FYI Center!\nID,Type,Description\n1,PNG,Portable Network Graphics\n2,GIF,Graphics Interchange Format\n", "inferred_title_then_header", ["ID", "Type", "Description"], 2, "Welcome to File Extension FYI Center!"),
        ("2026\nName,Value\nAcme,42\n", "synthetic_data_like_header", ["col_1", "col_2"], 3, None),
        ("test1\n", "synthetic_single_row", ["col_1"], 1, None),
        ("1\n2\n3\n", "synthetic_single_column", ["col_1"], 3, None),
        ("a,\n1,2\n", "inferred_first_row_header", ["a", "col_2"], 1, None),
        ("\n \n", "empty_table", [], 0, None),
    ],
)
def test_table_shapes(text, policy, headers, rows, caption):
    found = records.table_shape(delimited.parse(text)[1])
    assert (found[3], found[0], len(found[1]), found[2]) == (policy, headers, rows, caption)


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Name,Note,N\nx,"two\nlines, and ""quotes""",1\ny\n')
    (tmp_path / "b.tsv").write_text("Name\tSize\na,b\t3\n")
    (tmp_path / "c.csv").write_text("")
    found = {(r.path.rsplit("/", 1)[-1], r.row): r for r in delimited.scan_files(spark, f"{tmp_path}/*").collect()}
    assert {k: r.cells for k, r in found.items()} == {("a.csv", 0): ["x", 'two\nlines, and "quotes"', "1"], ("a.csv", 1): ["y", "", ""], ("b.tsv", 0): ["a,b", "3"]}
    assert found["b.tsv", 0].delimiter == "\t"
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "x.txt").write_text('a;b\n1;"2;3"\n')
    assert [tuple(r) for r in delimited.scan_lines(spark, f"{tmp_path}/lines").collect()] == [("a", "b"), ("1", "2;3")]


# ---- records


@pytest.mark.parametrize(
    "kind, text, expected",
    [
        ("json", '[{"a": 1}, {"b": [1, 2]}]', [{"a": 1}, {"b": [1, 2]}]), ("json", '{"a": 1}', [{"a": 1}]), ("json", '{"a": 1}\n{"a": 2}\n', [{"a": 1}, {"a": 2}]),
        ("json", "[1, 2]", []), ("json", "[]", []), ("json", '[{"a": 1}, 2]', []), ("json", '"x"', []), ("json", "", []),
        ("jsonl", '{"a": 1}\n\n {"b": 2} \n', [{"a": 1}, {"b": 2}]), ("jsonl", '{"a": 1}\nbad\n', []), ("jsonl", '{"a": 1}\n[1]\n', []),
        ("yaml", "a: 1\n---\nb: x\n", [{"a": 1}, {"b": "x"}]), ("yaml", "- a: 1\n- a: 2\n", [{"a": 1}, {"a": 2}]), ("yaml", "1: x\n", []), ("yaml", "just text\n", []), ("yaml", "a: [", []), ("yaml", "", []),
        ("toml", "a = 1\n[b]\nc = 'x'\n", [{"a": 1, "b": {"c": "x"}}]), ("toml", "a = 2024-01-01\n", []), ("toml", "a =", []), ("other", "{}", []),
    ],
)
def test_record_streams(kind, text, expected):
    assert streams.records(text, kind) == expected


def test_record_files(spark):
    rows = [("a.json", '[{"k": 1}]'), ("b.NDJSON", '{"k": 2}\n{"k": 3}'), ("c.yml", "k: 4"), ("d.toml", "k = 5"), ("e.bin", "{}"), ("f.json", None)]
    files = spark.createDataFrame([(n, t, "application/json; charset=utf-8" if n == "e.bin" else None) for n, t in rows], "path string, content string, media string")
    kind = streams.stream_format(F.col("path"), F.col("media"))
    found = {(r.path, r.ordinal): json.loads(r.record) for r in streams.read_records(files, kind).collect()}
    assert found == {("a.json", 0): {"k": 1}, ("b.NDJSON", 0): {"k": 2}, ("b.NDJSON", 1): {"k": 3}, ("c.yml", 0): {"k": 4}, ("d.toml", 0): {"k": 5}, ("e.bin", 0): {}}
    bad = spark.createDataFrame([("x.jsonl", '{"a": 1}\nno\n')], "path string, content string")
    with pytest.raises(Exception, match="line 2 is no JSON"):
        streams.read_records(bad, F.lit("jsonl"), strict=True).collect()


def test_wide_units_lose_no_field(spark):
    header = "[unit_ordinal=0] "
    fields = [f"early_{i:02}=value-{i}" for i in range(32)] + ["service.ports=5432:5432, 5672:5672", "service.webhooks=stock.low, stock.adjusted", "wide=" + "x" * 500]
    texts = [header + "fields: " + "; ".join(fields), header + "fields: a=1; b=2", "no unit " + "y" * 400, header + "fields: one=" + "z" * 400, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", streams.split_units(F.col("t"), 360).alias("u"))
    found = {r.i: r.u for r in rows.collect()}
    assert len(found[0]) > 3 and all(u.startswith(header + "fields: ") for u in found[0])
    assert [f for u in found[0] for f in u.removeprefix(header + "fields: ").split("; ")] == fields
    assert all(len(u) <= 360 or "; " not in u for u in found[0]) and all(len(a) + 2 + len(b.removeprefix(header + "fields: ").split("; ")[0]) > 360 for a, b in zip(found[0], found[0][1:], strict=False))
    assert [found[i] for i in (1, 2, 3)] == [[t] for t in texts[1:4]]


def test_focused_excerpts():
    unit = "[unit_ordinal=3] fields: " + "; ".join(f"k{i}=value number {i}" for i in range(40)) + "; late=Invoice total 42"
    found = streams.focused_excerpt(unit, ["invoice"], 90)
    assert found == "[unit_ordinal=3] fields: k39=value number 39; late=Invoice total 42"
    assert streams.focused_excerpt(unit, ["invoice"], 60) == "[unit_ordinal=3] fields: late=Invoice total 42"
    assert streams.focused_excerpt(unit, ["absent"], 90) is None and streams.focused_excerpt(unit, ["x"], 90) is None and streams.focused_excerpt(unit, ["invoice"], 20) is None
    assert streams.focused_excerpt(" short ", [], 90) == "short" and streams.focused_excerpt("", ["a"], 9) is None


def test_odd_tokens_are_all_that_can_be_unstable(spark):
    """The cheap test before the others leaves out no token that they would find."""
    from corvine.functions import quality

    documents = duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    words = sorted({w for (t,) in documents for w in (t or "").split()})[::3] + NOISE.split() + ["αaβbγ", "АbВc", "ÀbÉc", "ABc1", "a1b2", "getUserById", "plain"]
    rows = spark.createDataFrame([(w,) for w in words], "t string").select(clean_token(F.col("t")).alias("t"))
    assert rows.where((is_unstable(F.col("t")) | is_noise(F.col("t"))) & ~F.col("t").rlike(quality._ODD)).count() == 0
