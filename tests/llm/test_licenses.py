import pytest
from pyspark.sql import functions as F

from gneiss.llm import licenses as lic


@pytest.fixture(scope="module")
def model(make, prose):
    return lic.fit(make([(i, prose(60, i) + "\n" + prose(40, 100 + i)) for i in range(60)]))


def test_families_confirmed_and_unknown(make, prose, model):
    rows = [
        (1, f"{prose(20, 1)}\nLicensed under the Apache License, Version 2.0.\n{prose(20, 2)}"),
        (2, f"released under the MIT license. {prose(30, 3)}"),
        (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."),
        (5, "Licensed under a private agreement between the parties."),
        (6, prose(50, 4)), (7, None), (8, ""), (1, "Copyright 2020, all rights reserved"), (9, "Licensed under CC BY 4.0."),
        (10, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: " + prose(9, 1)),
        (11, f"licence plates {prose(4000, 5)}"), (None, "Licensed under the Mozilla Public License 2.0."),
    ]
    got = lic.scan(make(rows), model).collect()
    assert len(got) == len(rows)
    families = sorted((str(r["doc_id"]), r["families"]) for r in got)
    want = [(1, "Apache-2.0"), (2, "MIT"), (3, "GPL-3.0"), (4, "CC-BY-NC-4.0,MIT"), (5, ""), (6, ""), (7, ""), (8, ""), (1, ""), (9, "CC-BY-4.0"), (10, "BSD-3-Clause"), (11, ""), (None, "MPL-2.0")]
    assert families == sorted((str(i), f) for i, f in want)
    by = {r["doc_id"]: r for r in got}
    assert by[5]["n_unknown"] == 1 and by[6]["n_candidates"] == 0 and by[4]["n_confirmed"] == 2
    assert by[3]["probability"] > 0.6 and by[5]["probability"] is None


def test_held_out_variants(make, model):
    """Wordings with a word more or less than any training row's."""
    rows = [(i, t) for i, t in enumerate(["This file is released under the MIT License.", "licensed under the apache license version 2.0", "It is licensed under the GNU General Public License, version 3.", "All code here is licensed under CC BY-NC 4.0."])]
    got = {r["doc_id"]: r["families"] for r in lic.scan(make(rows), model).collect()}
    assert got == {0: "MIT", 1: "Apache-2.0", 2: "GPL-3.0", 3: "CC-BY-NC-4.0"}


def test_neighbouring_licences_are_not_confused(make, model):
    gpl = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
    rows = [
        (1, gpl.format(";", ";", 2)), (2, gpl.format(":", ",", 3)), (3, gpl.format(";", ";", 9)),
        (4, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
        (5, "This work is licensed under a Creative Commons Attribution 4.0 International License."),
        (6, "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
        (7, "This work is licensed under the GNU Lesser General Public License, version 3."), (8, "Licensed under CC BY-SA 4.0."),
    ]
    got = {r["doc_id"]: r["families"] for r in lic.scan(make(rows), model).collect()}
    wrong = {1: "GPL-3.0", 3: "GPL-3.0", 4: "CC-BY-4.0", 6: "CC-BY-4.0", 7: "GPL-3.0", 8: "CC-BY-4.0"}
    assert not any(f in got[i].split(",") for i, f in wrong.items())
    assert got[2] == "GPL-3.0" and got[5] == "CC-BY-4.0" and got[1] in ("GPL-2.0", "")


def test_empty_table(make, model):
    assert lic.scan(make([]), model).count() == 0
    lic.fit(make([]))


def test_paragraphs_without_stems_are_classed(make, prose, model):
    """No stem of the training's prose filter decides what is classed; paragraphs count each time they stand in a row."""
    part = "hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"
    assert not any(c in part.lower() for c in lic.CUES)
    rows = [(1, part), (2, f"{part}\n{prose(30, 9)}\n{part}\nReleased under the MIT License.\n \n"), (3, "\n\n"), (4, f"{prose(15, 1)}\n{prose(80, 2)}\n...")]
    got = {r["doc_id"]: (r["n_candidates"], r["families"], r["n_confirmed"], r["n_unknown"]) for r in lic.scan(make(rows), model).collect()}
    assert got == {1: (1, "MIT", 1, 0), 2: (3, "MIT", 3, 0), 3: (0, "", 0, 0), 4: (0, "", 0, 0)}


def test_margins_equal_a_plain_sum(make, model):
    """Scores against weights of the paragraph's distinct n-grams, summed in Python."""
    import re

    text = "This work is licensed under the MIT License, the MIT License. Over the sea. 2.0"
    w = [x.strip(".") for x in re.split(r"[^\w.]+", text.lower()) if x.strip(".")]
    grams = {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}
    at = {g: i for i, g in enumerate(model.grams.vocabulary)}
    weights, bias = model.regression.coefficientMatrix.toArray(), model.regression.interceptVector.toArray()
    want = bias + sum(weights[:, at[g]] for g in grams if g in at)
    got = model.margins(make([(1, text)]), "text").first()["z"]
    assert got == pytest.approx(list(want), abs=1e-9)
    assert lic.CLASSES[max(range(len(want)), key=lambda i: want[i])] == "MIT"


def test_calibration_rows_are_unseen_wordings(make):
    rows = lic.training_rows(make([])).filter("family NOT IN ('unknown', 'none')").collect()
    seen = {r["paragraph"] for r in rows if not r["held"]}
    assert {r["family"] for r in rows if r["held"]} <= {r["family"] for r in rows if not r["held"]}
    assert not any(r["paragraph"] in seen for r in rows if r["held"])


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("Version 2.0. See .gitignore ... or v.3", ["version", "2.0", "see", "gitignore", "or", "v.3"]),
        ("...", []), ("", []), (" . . a", ["a"]), ("..é. .漢2..", ["é", "漢2"]), ("a" + "." * 100_000 + "b", ["a" + "." * 100_000 + "b"]), (" ." * 100_000, []),
    ],
)
def test_words_have_no_dots_at_their_ends(make, line, want):
    assert make([(1, line)]).select(lic.words(F.col("text")).alias("w")).first()["w"] == want


def test_grams_of_counted_words_are_all_that_count(make, model):
    counted = set(model.grams.vocabulary)
    rows = make([(1, lic.NOTICES[0][1]), (2, "We saw zebras; licensed under zebras the MIT License zebras zebras, said the author."), (3, "zebras"), (4, "")])
    some = {r["doc_id"]: r["grams"] for r in lic.featured(rows, "text", model.grams).collect()}
    for r in lic.featured(rows, "text").collect():
        assert [g for g in some[r["doc_id"]] if g in counted] == [g for g in r["grams"] if g in counted]


def wrapped(text, columns, mark=""):
    import textwrap

    return "\n".join(mark + x for x in textwrap.wrap(text, columns))


@pytest.mark.parametrize("mark", ["", " * ", "# ", "// "])
@pytest.mark.parametrize("columns", [60, 72, 80])
def test_wrapped_notices_are_one_paragraph(make, prose, model, columns, mark):
    rows = [(i, f"{prose(50, i)}.\n\n{wrapped(t, columns, mark)}\n\n{prose(50, 50 + i)}.") for i, (_, t) in enumerate(lic.NOTICES)]
    got = {r["doc_id"]: (r["n_candidates"], r["families"], r["n_confirmed"], r["n_unknown"]) for r in lic.scan(make(rows), model).collect()}
    assert got == {i: (1, f, 1, 0) for i, (f, _) in enumerate(lic.NOTICES)}


def test_licences_without_a_template_are_unknown(make, prose, model):
    said = ["The EUPL, version 1.2, applies to this program.", "This program is licensed under the Eclipse Public License 2.0.", "This Font Software is licensed under the SIL Open Font License, Version 1.1.", "Released under the terms of the EUPL."]
    rows = [(i, f"{prose(60, i)}.\n{t}\n{prose(60, 70 + i)}.") for i, t in enumerate(said)]
    for r in lic.scan(make(rows), model).collect():
        assert (r["n_candidates"], r["families"], r["n_unknown"]) == (1, "", 1), said[r["doc_id"]]


def test_where_paragraphs_end(make):
    full = "a line that is as long as wrapped lines usually are, or longer"
    cases = {
        "one\ntwo": [["one"], ["two"]], f"{full}\nand more\nlast": [[full, "and more"], ["last"]], f"{full}\n\nnew": [[full], [""], ["new"]], f"// {full}\n// end. */\nnew": [[full, "end."], ["new"]],
        f"{full}.\nGoes on": [[f"{full}.", "Goes on"]], f"{full[:45]}.\nNew": [[f"{full[:45]}."], ["New"]], f"{full * 2}\nnext": [[full * 2], ["next"]], f"{full}\n{full * 2}": [[full], [full * 2]], f"{full}\n---\nx": [[full], [""], ["x"]], "": [[""]],
    }
    got = {r["text"]: r["p"] for r in make(list(enumerate(cases))).withColumn("p", lic.paragraphs(F.col("text"))).collect()}
    assert got == cases


def test_long_wrapped_paragraphs_are_classed_in_parts(make, prose, model):
    long = [prose(12, i)[:55].ljust(50, "x") for i in range(100)]
    at = wrapped(lic.NOTICES[6][1], 72).split("\n")
    got = lic.scan(make([(1, "\n".join([*long[:37], *at, *long[37:]]))]), model).first()
    assert (got["n_candidates"], got["families"], got["n_confirmed"], got["n_unknown"]) == (1, "MIT", 1, 0)


def test_ties_take_the_first_class(make):
    """Equal margins: the first class is the likeliest, and not likely enough to be named."""

    class Even(lic.Model):
        def margins(self, rows, paragraph):
            return rows.withColumn("z", F.array(*(F.lit(0.5) for _ in lic.CLASSES)))

    got = lic.scan(make([(1, "some words\nmore\n\n"), (2, "")]), Even(None, None, 1.0)).collect()
    assert {r["doc_id"]: (r["n_candidates"], r["n_unknown"], r["families"]) for r in got} == {1: (2, 2, ""), 2: (0, 0, "")}
