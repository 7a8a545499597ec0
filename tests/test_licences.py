"""Licence classification, resolution and the gate."""

import itertools

import pytest

from repoquarry import rules
from repoquarry.functions import licences as lic
from repoquarry.operators import licensing


def test_anchors_cover_every_phrase():
    phrases = itertools.chain.from_iterable(p for _, p in rules.LICENSE_PHRASES)
    assert all(any(a in phrase for a in rules.LICENSE_ANCHORS) for phrase in phrases)
    assert len(rules.LICENSE_PHRASES) == 17


def test_every_phrase_is_found(spark):
    rows = [(phrase, spdx) for spdx, phrases in rules.LICENSE_PHRASES for phrase in phrases]
    order = [p for _, phrases in rules.LICENSE_PHRASES for p in phrases]

    def expected(text):
        return next(spdx for spdx, phrases in rules.LICENSE_PHRASES if any(p in text for p in phrases))

    df = spark.createDataFrame([(f"x {p.upper()} y",) for p in order], "content string")
    got = [r["license"]["name"] for r in lic.classify_license(df).collect()]
    assert got == [expected(f"x {p} y") for p, _ in rows]


CASES = {
    "mit": ({"LICENSE": "MIT License\n\nCopyright (c) 2024 Test Author"}, ("MIT", True, "LICENSE")),
    "apache": ({"LICENSE": "Apache License\nVersion 2.0, January 2004"}, ("Apache-2.0", True, "LICENSE")),
    "bsd2": ({"LICENSE": "BSD 2-Clause License\nx"}, ("BSD-2-Clause", True, "LICENSE")),
    "bsd3": ({"LICENSE": "BSD 3-Clause License\nx"}, ("BSD-3-Clause", True, "LICENSE")),
    "gpl3": ({"LICENSE": "GNU General Public License v3\nx"}, ("GPL-3.0", True, "LICENSE")),
    "isc": ({"LICENSE": "ISC License\nx"}, ("ISC", True, "LICENSE")),
    "closed": ({"LICENSE": "Copyright 2024 Company. All rights reserved."}, ("Proprietary", False, "LICENSE")),
    "custom": ({"LICENSE": "Some custom license terms that don't match any pattern."}, ("Unknown", False, "LICENSE")),
    "nothing": ({"src/a.py": "x"}, (None, False, None)),
    "package": ({"package.json": '{"license":"MIT"}'}, ("MIT", True, "package.json")),
    "package_case": ({"package.json": '{"license":"mIt"}'}, ("mIt", True, "package.json")),
    "pyproject": ({"pyproject.toml": '[project]\nlicense = "Apache-2.0"\n'}, ("Apache-2.0", True, "pyproject.toml")),
    "sspl": ({"package.json": '{"license":"SSPL-1.0"}'}, ("SSPL-1.0", False, "package.json")),
    "unlicense": ({"LICENSE": "This is free and unencumbered software released"}, ("Unlicense", True, "LICENSE")),
    "permitted": ({"LICENSE": "All rights reserved. Use is permitted."}, ("Unknown", False, "LICENSE")),
    "permit": ({"LICENSE": "a permit license"}, ("MIT", True, "LICENSE")),
    "table": ({"pyproject.toml": 'license = {text = "MIT"}'}, ("text =", False, "pyproject.toml")),
    "object": ({"package.json": '{"license":{"type":"MIT"}}'}, (None, False, None)),
    "object_then_toml": ({"package.json": '{"license":{"type":"MIT"}}', "pyproject.toml": 'LICENSE="MIT"'}, ("MIT", True, "pyproject.toml")),
    "first_decides": ({"LICENSE.md": "odd", "COPYING": "MIT License", "package.json": '{"license":"MIT"}'}, ("Unknown", False, "LICENSE.md")),
    "broken_json": ({"package.json": '{"license":"MIT"} x'}, (None, False, None)),
    "repeated_key": ({"package.json": '{"license":"X","license":"ISC"}'}, ("ISC", True, "package.json")),
    "not_root": ({"docs/LICENSE": "MIT License"}, (None, False, None)),
}


@pytest.fixture(scope="module")
def resolved(spark):
    rows = [(repo, path, text) for repo, (files, _) in CASES.items() for path, text in files.items()]
    return licensing.resolve_license(spark.createDataFrame(rows, "repo_id string, path string, content string")).cache()


def test_resolution(resolved):
    got = {r["repo_id"]: (r["license"]["name"], r["license"]["permissive"], r["license"]["file"]) for r in resolved.collect()}
    assert got == {repo: expected for repo, (_, expected) in CASES.items()}


def test_gate(resolved):
    allowed, blocked = licensing.license_gate(resolved)
    reasons = {r["repo_id"]: r["reason"] for r in blocked.collect()}
    assert reasons["nothing"] == "No license file found."
    assert reasons["sspl"] == 'License "SSPL-1.0" is not permissive.'
    assert allowed.count() + blocked.count() == len(CASES)
    free, none = licensing.license_gate(resolved, dry_run=True)
    assert free.count() == len(CASES) and none.count() == 0


def test_metadata_gate(spark):
    rows = spark.createDataFrame([("a", "MIT"), ("b", None), ("c", "NOASSERTION")], "repo_id string, license string")
    allowed, blocked = licensing.metadata_gate(rows)
    assert [r["repo_id"] for r in allowed.collect()] == ["a"]
    assert {r["repo_id"]: r["reason"] for r in blocked.collect()} == {"b": "No license detected.", "c": 'License "NOASSERTION" is not permissive.'}


def test_is_permissive(column_of):
    assert column_of(lic.is_permissive, ["MIT", "apache-2.0", "BSD-3-Clause", "isc", "gpl-3.0", "unknown", None, ""]) == [True] * 5 + [False] * 3
