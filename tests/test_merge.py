"""Merge runs against a plain sequential version."""

import random

from scholion.functions.components import components
from scholion.operators import merge

ENT = "key string, entityType string, display_en_name string, display_heb_name string, all_en_names array<string>, alias_keys array<string>, roles array<string>, isWoman boolean"
ROW = "list string, row long, entity_type string, final_name string, names string, merged string"


def united(*lists):
    out = {}
    for x in (x for xs in lists for x in xs or []):
        if x:
            out.setdefault(x.lower(), x)
    return list(out.values())


def sequential(entities, rows):
    """One row after another on a dict of entities; statuses by row."""
    db, status = {e[0]: dict(zip(("key", "type", "name", "heb", "names", "alias", "roles", "woman"), e, strict=True)) for e in entities}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        _, n, kind, final, names, merged = r
        if (merged or "").strip().lower() in ("1", "true", "yes"):
            status[n] = "merged_already"
            continue
        if not (final or "").strip():
            status[n] = "error"
            continue
        asked = list(dict.fromkeys(x.strip().lower() for x in (names or "").split("|") if x.strip()))
        found = {}
        for x in asked:
            hits = [e for e in db.values() if e["type"] == kind and e["name"].lower() == x]
            if len(hits) > 1:
                status[n] = "ambiguous"
                break
            if hits:
                found[x] = hits[0]
        else:
            if len(found) < 2:
                status[n] = "nothing"
                continue
            target = found.get(final.strip().lower()) or next(iter(found.values()))
            for dup in found.values():
                if dup is not target:
                    target["name"] = final.strip().lower()
                    target["heb"] = target["heb"] or dup["heb"]
                    target["names"], target["alias"] = united(target["names"], dup["names"], [final]), united(target["alias"], dup["alias"], [dup["key"]])
                    target["roles"], target["woman"] = united(target["roles"], dup["roles"]), bool(target["woman"]) or bool(dup["woman"])
                    del db[dup["key"]]
            status[n] = "merge"
    return db, status


def run(spark, entities, rows):
    rels = spark.createDataFrame([("r1", "spokeWith", "e0", "e1"), ("r2", "spokeWith", "e2", "e3"), ("r3", "spokeWith", "zz", "e4")], "key string, rel_type string, term1 string, term2 string")
    meta = spark.createDataFrame([("p", ["e0", "e1", "e2", "zz"], ["r1", "r2", "r3"])], "key string, entity_keys array<string>, rel_keys array<string>")
    out = merge.apply_merge(spark.createDataFrame(entities, ENT), rels, meta, spark.createDataFrame(rows, ROW))
    db = {r.key: (r.display_en_name, r.display_heb_name or "", r.all_en_names, r.alias_keys, r.roles, bool(r.isWoman)) for r in out["entities"].collect()}
    return db, {r.row: r.status for r in out["rows"].collect()}, out


def check(spark, entities, rows):
    want, statuses = sequential(entities, rows)
    db, got, out = run(spark, entities, rows)
    assert got == statuses
    assert db == {k: (e["name"], e["heb"] or "", e["names"], e["alias"], e["roles"], bool(e["woman"])) for k, e in want.items()}
    return statuses, out


def test_random_runs_equal_a_sequential_one(spark):
    rng = random.Random(4)
    names = [f"Name {k}" for k in range(40)]
    for _ in range(3):
        ents = [(f"e{k}", rng.choice(["Person", "Person", "Place"]), rng.choice(names[: 36]).lower(), rng.choice([None, "", f"heb{k}"]), [f"N{k}"], [f"a{k}"] if k % 3 == 0 else [], [rng.choice(["King", "Judge"])], rng.choice([None, True, False])) for k in range(45)]
        rows = [("person_to_merge.csv", k, "Person", rng.choice([*names, "", None, " Name 1 "]), "|".join(rng.choice(names) for _ in range(rng.randint(0, 4))), rng.choice([None, None, None, "1"])) for k in range(60)]
        statuses, _ = check(spark, ents, rows)
        assert {"merge", "nothing", "ambiguous"} <= set(statuses.values())


def test_two_hundred_rows_on_one_name(spark):
    """Each row joins the next person to what the rows before it made of the first."""
    ents = [(f"e{k}", "Person", f"name {k}", "heb" if k == 150 else "", [f"N{k}"], [], [f"R{k % 5}"], k == 199) for k in range(201)]
    rows = [("person_to_merge.csv", k, "Person", "Name 0", f"name {k}|name 0", None) for k in range(1, 201)]
    statuses, out = check(spark, ents, rows)
    assert set(statuses.values()) == {"merge"}
    (one,) = out["entities"].collect()
    assert len(one.alias_keys) == 200 and one.display_heb_name == "heb" and one.isWoman
    assert out["rels"].collect() == [("r3", "spokeWith", "zz", "e0")] and [(r.entity_keys, r.rel_keys) for r in out["meta"].collect()] == [(["e0", "zz"], ["r3"])]


def test_renamed_chain(spark):
    """A target takes a new name that the next row looks for."""
    ents = [(f"e{k}", "Person", f"n{k}", "", [], [], [], False) for k in range(40)]
    rows = [("l", 1, "Person", "m1", "n0|n1", None)] + [("l", k, "Person", f"m{k}", f"m{k - 1}|n{k}", None) for k in range(2, 40)]
    statuses, out = check(spark, ents, rows)
    assert set(statuses.values()) == {"merge"} and out["entities"].count() == 1


def test_components(spark):
    edges = [(f"{a:03d}", f"{a + 1:03d}") for a in range(300) if a % 100 != 99] + [("x", "y"), ("y", "x"), ("z", "z")]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"{a:03d}": f"{a // 100 * 100:03d}" for a in range(300)} | {"x": "x", "y": "x"}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0
