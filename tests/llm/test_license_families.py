"""Further families by name, and SPDX expressions."""

import pytest

from tidewick.llm import licenses


@pytest.mark.parametrize(
    "text,label",
    [
        ("Distributed under the BSD license.", "bsd"), ("the Mozilla Public License 1.1", "mpl-1.1"), ("under the Artistic License 2.0", "artistic"), ("dedicated under CC0", "cc0"), ("CC0 1.0 Universal", "cc0"),
        ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "cc-by-nc-sa"), ("the European Union Public Licence", "eupl"), ("a bsd of license", ""), ("an artistic licence to lie", ""), ("mozilla public house", ""),
    ],
)
def test_names_of_further_families(text, label):
    found = licenses.Index({}, 0).scan(licenses.words_of(text))[4].split(",")
    assert (label in found) if label else found == [""]


@pytest.mark.parametrize(
    "line,labels",
    [
        ("MIT OR Apache-2.0", {"mit", "apache-2"}), ("(MIT AND (BSD-3-Clause OR Zlib))", {"mit", "bsd", "bsd-3", "zlib"}), ("GPL-2.0-or-later WITH Classpath-exception-2.0", {"gpl", "gpl-2"}), ("LGPL-2.1+", {"lgpl", "lgpl-2.1"}),
        ("Unknown-1.0 OR MIT", {"mit"}), ("MIT */ int main", {"mit"}), ("MIT\nApache-2.0 is another", {"mit"}), ("MIT and so on with ISC", {"mit"}), ("", set()), ("LicenseRef-x", set()),
    ],
)
def test_expressions(spark, line, labels):
    text = f"/* SPDX-License-Identifier: {line}"
    assert licenses.expression_labels(text) == labels
    assert licenses.expression_labels("SPDX License Identifier MIT") == set() == licenses.expression_labels(None)


def test_expressions_are_reported(spark):
    df = spark.createDataFrame([(1, "// spdx-license-identifier: mit or isc\nint x;"), (2, "no license"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert got[1].labels == "isc,mit" and got[1].score == 1.0 and got[1].base_labels == "" and (got[2].labels, got[3].labels, got[2].score) == ("", "", 0.0)
