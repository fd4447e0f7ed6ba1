"""Merged candidates, acronyms and claims on known cases and against brute force."""

import uuid

from pyspark.sql import functions as F

from corvine.functions.ids import NAMESPACE, uuid5
from corvine.operators import claims, merge
from corvine.plans import search as plans

ENTITIES = "chunk_id bigint, document_id bigint, label string, node_type string, alias string, summary string"
RELATIONS = "chunk_id bigint, document_id bigint, source_label string, target_label string, relation_type string, summary string"


def test_uuid5(spark):
    names = ["", "a", "node|person:é", "x" * 300, None]
    found = spark.createDataFrame([(n,) for n in names], "n string").select("n", uuid5(F.col("n")).alias("u")).collect()
    assert [r.u for r in found] == [n if n is None else str(uuid.uuid5(NAMESPACE, n)) for n in names]


def test_candidates_are_merged(spark):
    entities = [
        (1, 10, " Acme ", "organization", "ACME Inc", None), (1, 10, "acme", "concept", None, "a firm"), (2, 10, "ACME", "organization", "", "the firm"), (2, 10, "Widget", "artifact", None, None),
        (3, 11, "widget", "concept", None, None), (3, 11, "  ", "artifact", None, None), (3, 11, None, "artifact", None, None), (None, 11, "lost", "artifact", None, None), (2, 10, "Widget", "artifact", None, None),
    ]
    relations = [
        (1, 10, "Acme", "Bolt", "makes", "m1"), (2, 10, "ACME", "widget", " makes ", None), (2, 10, "acme", "Widget!", "makes", "m2"), (2, 10, "acme", "Acme?", "is", None),
        (2, 10, "acme", "bolt", "Is Made", None), (2, 10, "acme", "bolt", None, None), (2, 10, "", "bolt", "makes", None),
    ]
    merged = merge.merge_candidates(spark.createDataFrame(entities, ENTITIES), spark.createDataFrame(relations, RELATIONS))
    nodes = {r.canonical_key: r for r in merged.nodes.collect()}
    assert {k: (r.label, r.support_count, r.aliases, r.summary) for k, r in nodes.items()} == {
        "organization:acme": ("Acme", 2, ["ACME", "ACME Inc", "Acme", "acme"], "a firm"), "concept:bolt": ("Bolt", 1, ["Bolt"], None), "artifact:widget": ("Widget", 1, ["Widget", "Widget!", "widget"], None),
        "concept:widget": ("widget", 1, ["widget"], None), "document:10": ("10", 2, ["10"], None), "document:11": ("11", 1, ["11"], None),
    }
    edges = {r.canonical_key: (r.support_count, r.summary, r.from_node_id, r.to_node_id) for r in merged.edges.collect()}
    assert {k: v[:2] for k, v in edges.items()} == {
        "document:10--mentions--organization:acme": (2, None), "document:10--mentions--artifact:widget": (1, None), "document:11--mentions--concept:widget": (1, None),
        "organization:acme--makes--concept:bolt": (1, "m1"), "organization:acme--makes--artifact:widget": (1, "m2"),
    }
    assert edges["organization:acme--makes--concept:bolt"][2:] == (nodes["organization:acme"].node_id, nodes["concept:bolt"].node_id)
    evidence = merged.evidence.groupBy("target_kind", "target_id").count().collect()
    assert {r.target_id: r["count"] for r in evidence if r.target_kind == "node"} == {r.node_id: r.support_count for r in nodes.values()}
    assert {r["count"] for r in evidence} == {1, 2} and len(evidence) == len(nodes) + len(edges)
    assert sorted((r.reason, r.raw_relation_type or "") for r in merged.rejected.collect()) == [("degenerate_self_loop", "is"), ("empty_relation", ""), ("empty_relation", "Is Made")]


def test_a_second_run_gives_the_same_rows(spark):
    entities = spark.createDataFrame([(i, i % 7, f"label {i % 5}", ["concept", "artifact"][i % 2], f"a{i % 3}", None) for i in range(60)], ENTITIES)
    relations = spark.createDataFrame([(i, i % 7, f"label {i % 5}", f"Label {i % 4}", "uses", f"s{i}") for i in range(60)], RELATIONS)
    one, two = merge.merge_candidates(entities, relations), merge.merge_candidates(entities.repartition(7), relations.repartition(3))
    for name in ("nodes", "edges", "evidence", "rejected"):
        assert sorted(map(tuple, getattr(one, name).collect()), key=repr) == sorted(map(tuple, getattr(two, name).collect()), key=repr)


def test_identifiers():
    assert all(map(merge.is_identifier, ["AS", "getX", "a_b", "x1", "v1.2", "42"])) and not any(map(merge.is_identifier, ["word", "Word", "", "a b", "a(b", "é"]))


def test_glosses(spark):
    texts = {
        "The Central Processing Unit (CPU) runs.": [("CPU", "Central Processing Unit")], "a central-processing unit ( CPU ) runs": [("CPU", "central processing unit")],
        "Central Processing Unit (GPU)": [], "Unit (CPU)": [], "things (see below) and Random Access Memory (RAM), (RAM)": [("RAM", "Random Access Memory")],
        "No close (ABC": [], "4 Bit Code (4BC)": [], "äußere Über Name (ÄÜN)": [("ÄÜN", "äußere Über Name")], "one two (ot)": [], "x" * 5000 + "y Long Words (YLW)": [], "(AB)": [],
    }
    assert {t: list(merge.glosses(t)) for t in texts} == texts
    rows = spark.createDataFrame([(1, "Central Processing Unit (CPU)"), (2, None), (3, "Carbon Powered Umbrella (CPU) and again Carbon Powered Umbrella (CPU)")], "chunk_id int, text string")
    found = merge.gloss_table(rows)
    assert found.count() == 2
    nodes = spark.createDataFrame([("a", "central processing-unit"), ("b", "CPU"), ("c", "cpu"), ("d", "Carbon Powered Umbrella")], "node_id string, label string")
    evidence = spark.createDataFrame([("a", 1), ("b", 1), ("c", 3), ("d", 1), ("d", 3)], "node_id string, chunk_id int")
    assert sorted((r.node_id, r.alias) for r in merge.acronym_aliases(found, nodes, evidence).collect()) == [
        ("a", "CPU"), ("b", "Central Processing Unit"), ("c", "Carbon Powered Umbrella"), ("d", "CPU"),
    ]


def test_at_most_four_aliases_of_a_chunk(spark):
    text = " ".join(f"{a} {b} (XY)." for a, b in zip(["Xa", "Xb", "Xc", "Xd", "Xe"], ["Ya"] * 5, strict=True))
    rows = spark.createDataFrame([(1, text)], "chunk_id int, text string")
    nodes, evidence = spark.createDataFrame([("n", "XY")], "node_id string, label string"), spark.createDataFrame([("n", 1)], "node_id string, chunk_id int")
    assert sorted(r.alias for r in merge.acronym_aliases(merge.gloss_table(rows), nodes, evidence).collect()) == ["Xa Ya", "Xb Ya", "Xc Ya", "Xd Ya"]


def test_acronym_terms(spark):
    labels = {"Central Processing Unit": ["cp", "cpu", "pu"], "parseHTTPRequest": ["hr", "ph", "phr", "pph", "pphr", "pp"], "a b": [], "Unit 42": [], "One Two Three Four Five": ["fo", "ff", "otf"]}
    found = {r.l: r.t for r in spark.createDataFrame([(x,) for x in labels], "l string").select("l", merge.acronym_terms(F.col("l")).alias("t")).collect()}
    assert found["Central Processing Unit"] == labels["Central Processing Unit"] and found["a b"] == [] and found["Unit 42"] == []
    assert {"hr", "ph"} <= set(found["parseHTTPRequest"]) and {"ott", "tf", "ff", "ottf", "ttff"} <= set(found["One Two Three Four Five"]) and all(len(a) <= 4 for a in found["One Two Three Four Five"])


# ---- claims


def brute_claims(text):
    """Versions, dates and numbers, character by character."""
    word = lambda c: c.isalnum() or c == "_"
    more = lambda c: word(c) or c in ".+-"
    out = []
    for line in text.split("\n"):
        stripped = line.lstrip()
        digits = len(stripped) - len(stripped.lstrip("0123456789"))
        rest = stripped[digits + 1 :]
        if digits and stripped[digits : digits + 1] in (".", ")") and (not rest or rest[0].isspace()):
            line = rest
        for token in line.split():
            i = 0
            while i < len(token):
                c, before = token[i], token[i - 1] if i else ""
                if c in "vV" and not (before and more(before)):
                    end = i + 1
                    while end < len(token) and more(token[end]):
                        end += 1
                    if token[end - 1] == "." and (end == len(token) or token[end] in ")]}>'\"`"):
                        end -= 1
                    core, _, build = token[i + 1 : end].partition("+")
                    core, dash, pre = core.partition("-")
                    parts = core.split(".")
                    fine = lambda x: all(p and all(q.isalnum() or q == "-" for q in p) for p in x.split("."))
                    if len(parts) > 1 and all(p.isdigit() for p in parts) and (not dash or fine(pre)) and ("+" not in token[i:end] or fine(build)):
                        out.append((token[i:end], "prefixed_version"))
                        i = end
                        continue
                if c in "+-":
                    starts = i + 1 < len(token) and token[i + 1] in "0123456789" and not (before and word(before))
                else:
                    starts = c in "0123456789" and (not before or (before == ":" and not (i > 1 and (token[i - 2].isdigit() or token[i - 2] in ".:/-+"))) or not (word(before) or before in "./%+-:"))
                if starts:
                    end = i + 1
                    while end < len(token) and token[end] in "0123456789.:/-+%":
                        end += 1
                    if end == len(token) or not word(token[end]):
                        literal = token[i:end].rstrip(".:/-+")
                        out.append((literal, "numeric"))
                        i = end
                        continue
                i += 1
    return list(dict.fromkeys((t, k) for t, k in out if len(t.encode()) <= 64))


def test_claims_of_all_answers(spark, sf):
    answers = plans.answers(spark.read.parquet(f"{sf}/documents.parquet"))
    found = {}
    for r in claims.claims(answers, "doc_id", "text").collect():
        found.setdefault(r.doc_id, []).append((r.literal, "numeric" if r.kind == "iso_date" else r.kind))
    for r in answers.collect():
        n = r.doc_id
        assert [x for x in found[n] if x[1] == "fence"] == [(f"run --id {n}", "fence"), ("stop", "fence")]
        assert len([x for x in found[n] if x[1] == "code"]) == 2
        assert [x for x in found[n] if x[1] in ("numeric", "prefixed_version")] == brute_claims(r.text), n


def test_claim_cases(spark):
    cases = {
        "On 2024-02-29 and 2023-02-29, 99.5% of 1,200": [("2024-02-29", "iso_date"), ("2023-02-29", "numeric"), ("99.5%", "numeric"), ("1", "numeric"), ("200", "numeric")],
        "3. v1.2.3 (V2.0-rc.1). v3 xv1.2 v1.2.3.": [("v1.2.3", "prefixed_version"), ("V2.0-rc.1", "prefixed_version")],
        "port:8080 a12 -5 x=-7 12:30:": [("8080", "numeric"), ("-5", "numeric"), ("-7", "numeric"), ("12:30", "numeric")],
        "use `a b` and `a b` ```\nx = 1\n\ny\n``` `open": [("a b", "code"), ("x = 1", "fence"), ("y", "fence"), ("1", "numeric")],
        "```py\nz\n``` then ```never closed `a`": [("z", "fence")], "": [], "no claims": [],
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*cases, None])], "i int, t string")
    found = {}
    for r in claims.claims(rows, "i", "t").collect():
        found.setdefault(r.i, []).append((r.literal, r.kind))
    assert [found.get(i, []) for i in range(len(cases) + 1)] == [*cases.values(), []]


def test_states(spark):
    answers = spark.createDataFrame([(i,) for i in range(6)], "query_id int")
    checked = spark.createDataFrame([(0, "a", True), (0, "b", False), (1, "a", True), (2, "a", True), (3, "a", True)], "query_id int, literal string, supported boolean")
    flags = lambda *ids: spark.createDataFrame([(i,) for i in ids], "query_id int")
    found = {r.query_id: r.state for r in claims.verification_states(answers, checked, flags(0, 1, 2, 5), flags(0, 1)).collect()}
    assert found == {0: "insufficient_evidence", 1: "conflicting", 2: "verified", 3: "partially_supported", 4: "not_run", 5: "verified"}
