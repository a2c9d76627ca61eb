"""Program notices of the other versions of the GNU licences aren't taken for version 3 of the GPL."""

import pytest

from coppice.llm import licenses

NOTICE = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
CASES = [
    ("GPL-3.0", ("program", ":", "General Public", ",", "3")),
    ("GPL-2.0", ("program", ";", "General Public", ";", "2")),
    ("LGPL-2.0", ("library", ";", "Library General Public", ";", "2")),
    ("LGPL-2.1", ("library", ";", "Lesser General Public", ";", "2.1")),
    ("LGPL-3.0", ("library", ":", "Lesser General Public", ",", "3")),
    ("AGPL-3.0", ("program", ":", "Affero General Public", ",", "3")),
]


def test_notices_of_versions(spark):
    docs = spark.createDataFrame([(k, NOTICE.format(*x)) for k, (_, x) in enumerate(CASES)], "doc_id long, text string")
    got = {r.doc_id: (r.license, r.score, r.licenses) for r in licenses.scan(spark, docs).collect()}
    assert got == {k: (name, 1000, name) for k, (name, _) in enumerate(CASES)}
