import numpy as np
import pytest

from axiloom.llm import licences

#: (paragraph, family, whether it is confirmed; None if no call is to be made)
PROBES = [
    ("GNU Lesser General Public License version 3", "LGPL-3.0", True),
    ("This program is licensed under the GNU Affero General Public License version 3.", "AGPL-3.0", True),
    ("Licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "CC-BY-ND-4.0", True),
    ("This work is licensed under CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0", True),
    ("Released under the BSD 2-Clause License.", "BSD-2-Clause", True),
    ("The GNU Lesser General Public License v2.1 applies.", "LGPL-2.1", True),
    ("to any person obtaining a copy of this software and associated documentation files", "MIT", True),
    ("GPL-3.0-or-later", "GPL-3.0", True),
    ("All rights reserved", "Proprietary", True),
    # versions and licences that there is no template of: never confirmed
    ("CC BY-SA 3.0", None, False),
    ("Licensed under CC BY 3.0.", None, False),
    ("Licensed under the Apache License, Version 1.1.", None, False),
    ("Licensed under the GNU General Public License, version 1.", None, False),
    ("Licensed under the MIT or Apache License 2.0.", None, False),
    ("Licensed under the Foo License, Version 2.0.", None, False),
    ("even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", None, False),
    # no licences
    ("a licence to kill, they said, and gave permission to nobody in particular", None, None),
    ("The museum is open from nine to five.", None, None),
]
MIT = """Some prose that stands first.

Permission is hereby granted, free of charge, to any person obtaining a
copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
More prose comes after it. And ends."""


@pytest.fixture(scope="module")
def model(spark, make, corpus):
    return licences.fit(make(corpus))


def test_probes(model):
    for text, family, sure in PROBES:
        got = model.call(text)
        assert (got is None) == (sure is None), text
        if got is not None:
            assert got[3] == sure and (family is None or got[0] == family), (text, got)
    told = [t for ts in licences.TEMPLATES.values() for t in ts]
    for family, texts in licences.TEMPLATES.items():
        for t in texts:
            name, _, _, sure = model.call(t)
            assert sure and name == family or "WITHOUT ANY WARRANTY" in t and not sure, t
    assert len(told) > 150 and model.calibration < 0.05


def test_a_wrapped_notice_is_one_paragraph(model):
    found = list(model.paragraphs(MIT))
    assert [MIT[a:b].split()[0] for a, b in found] == ["Permission", "THE"] and [MIT[a:b].split()[-1] for a, b in found] == ["conditions:", "NONINFRINGEMENT."]
    assert all(model.call(MIT[a:b])[0] == "MIT" and model.call(MIT[a:b])[3] for a, b in found)
    one = "She wrote it all. This work is licensed under CC BY-NC 4.0. Nobody read it."
    assert [one[a:b].strip() for a, b in model.paragraphs(one)] == ["This work is licensed under CC BY-NC 4.0."]


def test_scan_finds_what_one_by_one_is_found(spark, make, corpus, model):
    """Against the classifier on each unit in turn: wrapped templates, words left out, odd texts, repeated and null ids."""
    rng = np.random.default_rng(8)
    lines = ["", " - ", "İ of the work Σ", "first line", *(t for t, _, _ in PROBES), *MIT.split("\n")]
    for t in [t for ts in licences.TEMPLATES.values() for t in ts][::5]:
        ws = t.split()
        lines += [" ".join(ws[k : k + 8]) for k in range(0, len(ws), 8)]
        lines.append(" ".join(w for w in ws if rng.random() > 0.2))
    texts = [*corpus, MIT, MIT, "\n".join(lines), *("\n".join(lines[k : k + 7]) for k in range(0, len(lines), 7)), " ".join(lines) * 3]
    ids = [None if k % 11 == 0 else k // 2 for k in range(len(texts))]
    want = [(k, a, b, *model.call(t[a:b])) for k, t in zip(ids, texts) if t for a, b in model.paragraphs(t) if model.call(t[a:b]) is not None]
    got = list(map(tuple, licences.scan(make(texts, ids=ids), model).collect()))
    key = lambda r: tuple((x is None, x or 0) for x in r[:3])
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) > 40
    assert licences.scan(make([]), model).count() == 0 and licences.scan(make([None, "", " \n"]), model).count() == 0
    empty = licences.fit(make([]))
    assert empty.call("Released under the MIT License.")[0] == "MIT"


def test_units():
    text = "One two. Three\nfour;  five.six\n \n...\n- x: y"
    assert [(text[a:b], fresh) for a, b, fresh in licences.units_of(text)] == [("One two.", True), (" Three", False), ("four;", False), ("  five.six", False), ("- x:", True), (" y", False)]
