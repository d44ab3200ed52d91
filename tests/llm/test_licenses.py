import re

from inkstone.llm import licenses
from tests.llm import odd

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    w = words(text)
    places = [(k, lab) for phrase, lab in licenses.BASE for k in range(len(w)) if w[k:k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({lab for _, lab in places})))


TEXTS = [
    "mit license mit license MIT\nLICENSE", "The MIT, (License)", "mit licenses", "submit license", "mit é license",
    "GNU General Public License and General Public License; Apache License", "Kmit license mit licenseK", "K mit license",
    "mıt license", "MİT LICENSE", "general public", "general public public license general public license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Permission is hereby granted, totally free of charge, to any person obtaining one copy of this fine software and associated "
    "documentation files", "you may obtain a copy of the weather", "Licensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.",
]


def test_base_places_match_brute_force_with_odd_rows(spark):
    rows = [(i, t) for i, t, *_ in odd.rows()] + [(1000 + k, t) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = licenses.scan(docs).collect()
    cols = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted(((r["doc_id"], *(r[c] for c in cols)) for r in got), key=repr) == sorted(((i, *base(t)) for i, t in rows), key=repr)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)


def test_own_templates_survive_inserted_and_changed_words(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    labels = {k: got[k]["labels"] for k in got}
    assert labels[12] == labels[13] == "mit" and got[12]["n_base"] == got[13]["n_base"] == 0
    assert got[12]["score"] == 1.0 and licenses.COVER <= got[13]["score"] < 1
    assert labels[14] == "" and labels[15] == "cc-by-nc-4.0" and labels[16] == "gpl,gpl-3.0" and labels[17] == "mit"
    assert [(s["start"], s["label"]) for s in got[17]["spans"]][0] == (0, "mit")


def test_extra_columns_and_empty_table(spark):
    assert licenses.scan(odd.documents(spark)).count() == len(odd.rows())
    assert licenses.scan(odd.empty(spark)).count() == 0
