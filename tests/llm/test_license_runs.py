"""Notices of several paragraphs inside other text."""

from noticeweave.llm.licenses import scan_licenses

GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""


def test_runs_of_paragraphs(spark):
    other = "Some words that say nothing of the matter. " * 30
    rows = [(1, f"{other}\n\n{GPL}\n{other}\n\nend"), (2, f"a title\n\n{other}\n\n{APACHE}\n{other}"), (3, f"{other}\n\n{other}\n\n{other}"), (4, None), (5, "a\n\n\n\nb\n\nc")]
    got = {r.doc_id: {(m.template, m.unit, m["index"]) for m in r.licenses} for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert ("gpl-3.0-notice", "2 paragraphs", 1) in got[1]
    assert ("apache-2.0-notice", "3 paragraphs", 2) in got[2]
    assert not got[3] and not got[4] and not got[5]


def test_whole_licences_in_files(spark, tmp_path):
    from noticeweave.llm.licenses import TEMPLATES, read_templates

    other = "Some words that say nothing of the matter. " * 30
    rows = []
    for i, name in enumerate(n for n in sorted(TEMPLATES) if n.endswith("-text")):
        lines = "\n\n".join("\n".join(p[k : k + 70] for k in range(0, len(p), 70)) for p in TEMPLATES[name].split("\n\n"))
        rows += [(2 * i, f"Some Licence\n\nCopyright (c) 2024, A. Author\n\n{TEMPLATES[name]}\n"), (2 * i + 1, f"{other}\n\n{TEMPLATES[name].upper()}\n\n{other}")]
        assert len(lines) > 300
    names = sorted(n for n in TEMPLATES if n.endswith("-text"))
    got = {r.doc_id: {m.template for m in r.licenses} for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, name in enumerate(names):
        assert name in got[2 * i] and name in got[2 * i + 1]
    (tmp_path / "own.txt").write_text("You may use this file\n\nas you like it, but not sell it to others who may not.")
    own = read_templates(spark, str(tmp_path))
    assert list(own) == ["own"]
    found = scan_licenses(spark.createDataFrame([(1, f"x\n\n{own['own']}\n\ny")], "doc_id long, text string"), own).collect()
    assert [(m.template, m.unit) for m in found[0].licenses][-1] == ("own", "2 paragraphs")
