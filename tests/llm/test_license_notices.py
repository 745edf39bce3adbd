"""Licence scans: public notices as they stand in files, and the SQL of the query on the same texts."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from surveyeval.llm import licenses

BSD3 = """// Copyright 2008, Google Inc.
// All rights reserved.
//
// Redistribution and use in source and binary forms, with or without
// modification, are permitted provided that the following conditions are
// met:
//
//     * Redistributions of source code must retain the above copyright
// notice, this list of conditions and the following disclaimer.
//     * Redistributions in binary form must reproduce the above
// copyright notice, this list of conditions and the following disclaimer
// in the documentation and/or other materials provided with the
// distribution.
//     * Neither the name of Google Inc. nor the names of its
// contributors may be used to endorse or promote products derived from
// this software without specific prior written permission.
"""
GPL3 = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.
"""
GPL2 = """                    GNU GENERAL PUBLIC LICENSE
                       Version 2, June 1991

 Copyright (C) 1989, 1991 Free Software Foundation, Inc.,
 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software.
"""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:
"""
EPL = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License v. 2.0 which is available at
http://www.eclipse.org/legal/epl-2.0.
"""
NOTICES = [
    (1, BSD3, "BSD-3-Clause", "permissive"),
    (2, GPL3, "GPL-3.0", "copyleft"),
    (3, GPL2, "GPL-2.0", "copyleft"),
    (4, ZLIB, "Zlib", "permissive"),
    (5, BOOST, "BSL-1.0", "permissive"),
    (6, EPL, "EPL-2.0", "copyleft"),
    (7, "// SPDX-License-Identifier: GPL-2.0-or-later\nint main;", "GPL-2.0", "copyleft"),
    (8, "# SPDX-License-Identifier: MIT OR Apache-2.0", "Apache-2.0+MIT", "permissive"),
    (9, "/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note OR BSD-3-Clause) */", "BSD-3-Clause+GPL-2.0", "copyleft+permissive"),
    (10, "SPDX-License-Identifier: LicenseRef-unknown", "", ""),
    (11, "Copyright 2020 A. Person, all rights reserved.", "proprietary", "restricted"),
    (12, "A page about cooking.\nAll rights reserved.", "proprietary", "restricted"),
    (13, "This crate is licensed under either of the Apache License, Version 2.0 or the MIT license at your option.", "Apache-2.0+MIT", "permissive"),
    (14, "Notes: Released under the MIT license. All rights reserved.", "MIT", "permissive"),
    (15, BSD3.replace("\n//", " "), "BSD-3-Clause", "permissive"),
    (16, None, "", ""),
    (17, "", "", ""),
    (18, "The library was released under a license of some kind.", "", ""),
    (19, "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)", "BSL-1.0", "permissive"),
    (20, "word " * 40_000 + "\n\n" + ZLIB, "Zlib", "permissive"),
]


@pytest.fixture(scope="module")
def scanned(spark):
    docs = spark.createDataFrame([(i, text, "x") for i, text, _, _ in NOTICES], "doc_id long, text string, hold string")
    return licenses.license_scan(docs).toPandas().set_index("doc_id")


@pytest.mark.parametrize("doc_id,names,kinds", [(i, names, kinds) for i, _, names, kinds in NOTICES])
def test_notice(scanned, doc_id, names, kinds):
    assert (scanned.loc[doc_id, "licenses"], scanned.loc[doc_id, "kinds"]) == (names, kinds)


def test_sql_knows_the_whole_table(scanned):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(i, text) for i, text, _, _ in NOTICES], columns=["doc_id", "text"]))
    want = con.execute(licenses.op10_oracle()).df().set_index("doc_id").sort_index()
    pd.testing.assert_frame_equal(scanned.sort_index()[want.columns], want, check_dtype=False)


def test_own_table_of_sentences(spark):
    docs = spark.createDataFrame([(1, "You may copy this freely. SPDX-License-Identifier: MIT"), (2, "All rights reserved.")], "doc_id long, text string")
    got = licenses.license_scan(docs, known={"free": "you may copy this freely"}, rules=[("own", "permissive", ["free"])]).orderBy("doc_id").collect()
    assert [(r["licenses"], r["kinds"]) for r in got] == [("own", "permissive"), ("", "")]
