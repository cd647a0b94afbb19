"""Licence notices that are wrapped over lines, as in the headers of source files."""

import textwrap

import pytest
from mapstone.llm import license_scan

from . import plain_license

HEADERS = {
    "BSD": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the\n\"License\"); you may not use this file except in compliance\nwith the License.",
}


def commented(text, sign, top="", end=""):
    return "\n".join([top, *(f"{sign}{x}" for x in text.split("\n")), end, "", "int main() {", "}"])


def texts():
    for family, t in HEADERS.items():
        yield family, t
        yield family, "Some words before\n\n" + t + "\n\nand after"
        for sign, top, end in ((" * ", "/*", " */"), ("// ", "", ""), ("# ", "#", "#"), ("-- ", "", ""), ("//", "", "")):
            yield family, commented(t, sign, top, end)


def test_wrapped_headers_are_found(spark):
    rows = list(texts())
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    for i, (family, t) in enumerate(rows):
        want = plain_license.scan(t)
        assert {k: got[i][k] for k in want} == want, t
        assert (got[i].family, got[i].families, got[i].n_notices) == (family, family, 2 if family == "MPL-2.0" else 1), t  # both sentences of the MPL header are notices


@pytest.mark.parametrize("text,families", [("All rights reserved.\nReleased under the MIT License.", "MIT,Proprietary"), ("prose without an end\nSPDX-License-Identifier: MIT\nSPDX-License-Identifier: Apache-2.0\nmore", "Apache-2.0,MIT")])
def test_notices_on_lines_of_their_own_stay_apart(spark, text, families):
    got = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got.families, got.n_notices) == (families, 2) and plain_license.scan(text)["families"] == families


GRANT = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."


def test_every_template_and_grant_at_any_width_has_its_family(spark):
    notices = [(f, t) for f, ts in license_scan.TEMPLATES.items() for t in ts]
    notices += [("GPL-2.0", GRANT.replace("software:", "software;").replace("version 3", "version 2")), ("AGPL-3.0", GRANT.replace("GNU", "GNU Affero")), ("LGPL", GRANT.replace("program", "library").replace("GNU", "GNU Lesser"))]
    rows = []
    for family, t in notices:
        for width in (40, 55, 70, 80):
            for sign in ("", "# ", "// ", " * "):
                rows.append((family, "\n".join(sign + x for x in textwrap.wrap(t, width))))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    wrong = [(f, got[i].families, t) for i, (f, t) in enumerate(rows) if got[i].families != f or got[i].family != f]
    assert not wrong, wrong[:5]


def test_the_gate_loses_no_template():
    gate = set(license_scan.gate_words())
    for ts in license_scan.TEMPLATES.values():
        for t in ts:
            p = plain_license.pairs(plain_license.tokens(t))
            assert sum(not gate & set(x.split()) for x in p) / len(p) < license_scan.CONFIRM, t
