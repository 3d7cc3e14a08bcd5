"""Licence headers as they are wrapped in files."""

import itertools

import duckdb

from aeolia.llm import licences
from tests.comparing import of_duckdb, of_spark


MIT = """Permission is hereby granted, free of charge, to any person

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
"""
BSD = """1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
APACHE = """you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed"
WRAPPED = {"mit": (MIT, "mit-notice,mit-warranty"), "bsd": (BSD, "bsd-source,bsd-binary"), "apache-2.0": (APACHE, "apache-compliance,apache-copy,apache-as-is,apache-see"), "mpl-2.0": (MPL, "mpl2-ref")}


def test_wrapped_licences(spark):
    signs = ["", " * ", "# ", "// ", "-- ", "\t"]
    cases = [(n, ids, "".join(s + x for x in t.splitlines(True)), e) for (n, (t, ids)), s, e in itertools.product(WRAPPED.items(), signs, ("\n", "\r\n"))]
    docs = spark.createDataFrame([(k, t.replace("\n", e)) for k, (_, _, t, e) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: (r.licences, r.sentence_ids) for r in licences.scan(docs).collect()}
    assert got == {k: (n, ids) for k, (n, ids, _, _) in enumerate(cases)}


def test_licences_apart_and_spaced(spark):
    texts = ["Released into the public  domain.", "released into the public\tdomain", "all rights\n\nreserved", "All rights.\nReserved", "not all rights reserved", "MIT License\nLicensed under the MIT License", "a\n.....\nAll rights reserved"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licences.scan(docs).collect()}
    assert got == {0: "public-domain", 1: "public-domain", 2: "", 3: "", 4: "", 5: "mit", 6: "rights-reserved"}


def test_sql_says_the_same_of_wrapped_headers(spark):
    signs = ["", " * ", "# ", "// ", "-- ", "\t"]
    texts = ["".join(s + x for x in t.splitlines(True)).replace("\n", e) for t, _ in WRAPPED.values() for s in signs for e in ("\n", "\r\n", "\r")]
    texts += [a + gap + b for (a, _), (b, _) in itertools.product(WRAPPED.values(), repeat=2) for gap in ("", "\n", "\n\n", " -- ")]
    texts += [
        "Released into the public  domain.", "all rights\n\nreserved", "All rights.\nReserved", "MIT License. MIT License; MIT License\nMIT License", "a..b All rights reserved", "...\nAll rights reserved..", None, "",
        "v2.0. All rights reserved! x", "PLP All rights reserved L", "not all rights reserved", "All rights reserved." * 3, "All rights reserved. " * 3,
    ]
    docs = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], "doc_id long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(k // 2, t) for k, t in enumerate(texts)])
    assert of_spark(licences.scan(docs)) == of_duckdb(con, licences.OP10_SQL)
