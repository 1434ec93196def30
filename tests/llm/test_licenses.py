import pytest
from sigtrail.llm import license_scan as L

GNU = """{c}This program is free software; you can redistribute it and/or modify
{c}it under the terms of the GNU {kind} as published by
{c}the Free Software Foundation; either version {version} of the License, or
{c}(at your option) any later version.
"""
GPL, LGPL = "General Public License", "Lesser General Public License"


def scan(spark, files):
    rows = [(k, p, t, "x") for k, (p, t) in enumerate(files)]
    return {r.path: r for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string, license string")).collect()}


def test_names_and_versions_decide(spark):
    got = scan(spark, [
        ("g2.c", GNU.format(c=" * ", kind=GPL, version=2) + "int x;\n" * 40), ("g3.c", GNU.format(c="# ", kind=GPL, version=3) + "x = 1\n" * 40), ("l21.c", GNU.format(c="// ", kind=LGPL, version="2.1") + "int x;\n" * 40),
        ("l3.c", GNU.format(c="// ", kind=LGPL, version=3) + "int x;\n" * 40), ("a3.c", GNU.format(c="// ", kind="Affero " + GPL, version=3) + "int x;\n" * 40),
        ("lib/LICENSE", "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n\n Copyright (C) 1991, 1999 Free Software Foundation, Inc.\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n"),
        ("art.c", "// Licensed under the Artistic License 2.0\nint x;\n"), ("ap.c", "// Licensed under the Apache License, Version 2.0\nint x;\n"), ("cc.md", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.\n"),
        ("cc3.md", "This work is licensed under a Creative Commons Attribution 3.0 International License.\n"), ("mpl1.c", "// This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.\n"),
    ])
    assert {p: r.license for p, r in got.items()} == {
        "g2.c": "GPL-2.0", "g3.c": "GPL-3.0", "l21.c": "LGPL-2.1", "l3.c": "LGPL-3.0", "a3.c": "AGPL-3.0", "lib/LICENSE": "LGPL-2.1", "art.c": None, "ap.c": "Apache-2.0", "cc.md": "CC-BY-SA-4.0", "cc3.md": None, "mpl1.c": None,
    }


@pytest.mark.parametrize(("tag", "ids"), [
    ("SPDX-License-Identifier: MIT OR Apache-2.0", ["Apache-2.0", "MIT"]), ("SPDX: mit or apache-2.0", ["Apache-2.0", "MIT"]), ("SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) AND bsd-3-clause", ["BSD-3-Clause", "GPL-2.0"]),
    ("SPDX-License-Identifier: LGPL-2.1+ */", ["LGPL-2.1"]), ("SPDX-License-Identifier: Artistic-2.0", ["Artistic-2.0"]),
])
def test_spdx_expressions(spark, tag, ids):
    got = scan(spark, [("a.c", f"// {tag}\nint x;\n")])["a.c"]
    assert got.licenses == ids and got.license in ids and got.score == 1.0 and got.origin == "header"


def test_only_license_files_are_inherited(spark):
    mit = " ".join(["MIT License", L._MIT, L._MIT_NOTICE, L._AS_IS])
    got = scan(spark, [
        ("top/LICENSE", mit), ("top/a.c", "int x;"), ("top/odd/LICENSE", "You may do what your neighbour allows, under a licence of their own."), ("top/odd/b.c", "int x;"), ("top/odd/deep/c.c", "int x;"), ("top/odd/deep/d.c", "// Released under the MIT License.\nint y;"),
        ("c/y.c", "// Licensed under the MIT License.\nint y;\n"), ("c/z.c", "int z;"), ("e/words.txt", mit), ("e/f.c", "int f;"), (None, "int g;"), ("top/two/COPYING", mit + "\n\nLicensed under the Apache License, Version 2.0.\n"), ("top/two/x.c", None), ("top/empty/LICENSE", ""), ("top/empty/x.c", "int"),
    ])
    assert {p: (r.license, r.origin) for p, r in got.items()} == {
        "top/LICENSE": ("MIT", "file"), "top/a.c": ("MIT", "inherited"), "top/odd/LICENSE": (None, None), "top/odd/b.c": (None, None), "top/odd/deep/c.c": (None, None), "top/odd/deep/d.c": ("MIT", "header"),
        "c/y.c": ("MIT", "header"), "c/z.c": (None, None), "e/words.txt": ("MIT", "file"), "e/f.c": ("MIT", "inherited"), None: (None, None), "top/two/COPYING": (got["top/two/COPYING"].license, "file"), "top/two/x.c": (got["top/two/COPYING"].license, "inherited"),
        "top/empty/LICENSE": (None, None), "top/empty/x.c": (None, None),
    }
    assert got["top/two/COPYING"].licenses == ["Apache-2.0", "MIT"] == got["top/two/x.c"].licenses


def test_ties_repeats_and_null_ids(spark):
    both = "// Released under the MIT License.\n// Released under the ISC License.\n"
    rows = [(None, "a.c", both), (1, "a.c", both), (1, "a.c", both), (1, "a.c", "other"), (None, None, None)]
    got = [(r.doc_id, r.path, r.licenses, r.origin) for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()]
    assert sorted(got, key=str) == sorted([(None, "a.c", ["ISC", "MIT"], "header"), *[(1, "a.c", ["ISC", "MIT"], "header")] * 2, (1, "a.c", None, None), (None, None, None, None)], key=str)
