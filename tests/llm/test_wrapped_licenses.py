"""Whole licence texts, wrapped at 75 columns and inside comments."""

import textwrap

from epochalis.llm import licenses

MIT = ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, " + "DAMAGES OR OTHER LIABILITY, " * 20 + "ARISING FROM THE SOFTWARE."]
BSD = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software."]
GPL = ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY."]
MPL = ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."]

MORE = [
    (["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'], "ISC"),
    (["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."], "Unlicense"),
    (["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software."], "BSL-1.0"),
    (["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"], "EPL-2.0"),
    ([GPL[0].replace("GNU General", "GNU Affero General").replace("version 2", "version 3"), GPL[1]], "AGPL-3.0"),
    ([GPL[0].replace("This program", "This library").replace("GNU General", "GNU Lesser General"), GPL[1].replace("program", "library")], "LGPL"),
    ([GPL[0].replace("version 2", "version 3"), GPL[1], "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."], "GPL-3.0"),
    (["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."], "Zlib"),
]


def test_wrapped_licenses(spark):
    wanted = [(MIT, "MIT"), (BSD, "BSD-3-Clause"), (GPL, "GPL-2.0"), (MPL, "MPL-2.0"), *MORE]
    wraps = [lambda x: "\n\n".join(textwrap.fill(p, 75) for p in x), lambda x: "/*\n" + "\n *\n".join(textwrap.fill(p, 75, initial_indent=" * ", subsequent_indent=" * ") for p in x) + "\n */", lambda x: "\r\n#\r\n".join(textwrap.fill(p, 75, initial_indent="# ", subsequent_indent="# ").replace("\n", "\r\n") for p in x)]
    cases = [(w(x), name) for x, name in wanted for w in wraps]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: (r.licenses, r.sentence_ids) for r in licenses.scan(df).collect()}
    for i, (_, name) in enumerate(cases):
        assert got[i][0] == [name], (i, got[i])
    assert all("NoLiability" in got[i][1] for i in range(3))
