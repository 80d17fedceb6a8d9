"""Standard licence texts, wrapped as files carry them."""

import re
import textwrap

import pytest

from evalspark.llm import licences

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
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
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
WARRANTY = """
This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.
"""
AS_IS = MIT[MIT.index("THE SOFTWARE IS") :]
CC_NC = "This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License.\n"
CC = "This work is licensed under a Creative Commons\nAttribution 4.0 International License.\n"
BSD_CLAUSES = """
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

"""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""
BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE.
"""
BSD_HEAD = BSD[: BSD.index("1.")]
LESSER = GPL.replace("GNU General", "GNU Lesser General").replace("This program", "This library")
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
#: A text for each rule, in the order of the rules.
TEXTS = [
    "MIT License\n\nCopyright (c) 2024 A. Body\n\n" + MIT,
    MIT,
    APACHE,
    GPL + WARRANTY,
    GPL,
    "This work is licensed under the GNU\nGeneral Public License, version 3.\n",
    GPL.replace("version 3", "version 2") + WARRANTY,
    GPL.replace("version 3", "version 2"),
    GPL[: GPL.index(", either")] + ", version 2.\n",
    "Licensed under the GNU General Public License version 2\n",
    LESSER.replace("version 3", "version 2.1") + WARRANTY.replace("This program", "This library"),
    LESSER.replace("version 3", "version 2.1"),
    LESSER,
    GPL.replace("GNU General", "GNU Affero General"),
    "Released under the GNU Affero General Public License, version 3.\n",
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not "
    "distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.\n",
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.\n",
    "This program and the accompanying materials\nare made available under the terms of the Eclipse Public License "
    "v1.0\nwhich accompanies this distribution, and is available at\nhttp://www.eclipse.org/legal/epl-v10.html\n",
    "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\n"
    "which is available at https://www.eclipse.org/legal/epl-2.0/\n",
    'The contents of this file are subject to the terms of the\nCommon Development and Distribution License (the "License").\n',
    BSD_HEAD + BSD_CLAUSES + BSD_THIRD + BSD_AS_IS,
    BSD_HEAD + BSD_CLAUSES + BSD_AS_IS,
    "Licensed under the\nApache License, Version 2.0.\n",
    ISC,
    ISC[: ISC.index(", provided")] + ".\n",
    "Permission to use, copy, modify, and distribute this software and its\ndocumentation for any purpose, without fee, "
    "and without a written agreement\nis hereby granted, provided that the above copyright notice and this\nparagraph and "
    "the following two paragraphs appear in all copies.\n",
    "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to "
    "alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. The origin stays known.\n",
    "Permission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and "
    'accompanying documentation covered by\nthis license (the "Software") to use, reproduce, display, distribute,\n'
    "execute, and transmit the Software, and to prepare derivative works of the\nSoftware, and to permit third-parties to "
    "whom the Software is furnished to\ndo so, all subject to the following:\n\nThe copyright notices stay.\n",
    "This is free and unencumbered software\nreleased into the public domain.\n",
    "Everyone is permitted to copy and distribute verbatim or modified\ncopies of this license document, and changing it "
    "is allowed as long\nas the name is changed.\n",
    "This Font Software is licensed under the SIL Open Font License,\nVersion 1.1.\n",
    "This work is licensed under CC0 1.0.\n",
    CC_NC.replace("NonCommercial", "NonCommercial-ShareAlike"),
    CC_NC.replace("NonCommercial", "NonCommercial-NoDerivatives"),
    CC_NC,
    CC_NC.replace("NonCommercial", "ShareAlike"),
    CC_NC.replace("NonCommercial", "NoDerivatives"),
    CC,
    "This project is licensed\nunder the MIT License.\n",
    BSD,
]


def _rewrapped(text, width):
    return "\n\n".join(textwrap.fill(p, width, break_on_hyphens=False, break_long_words=False) for p in re.split(r"\n\s*\n", text))


@pytest.mark.parametrize("form", ["standard", "comments", "crlf", "narrow"])
def test_each_rule_on_its_wrapped_text(spark, form):
    put = {
        "standard": lambda t: "Some words first\n" + t + "and after",
        "comments": lambda t: "".join(f" * {line}\n" for line in t.splitlines()),
        "crlf": lambda t: t.replace("\n", "\r\n"),
        "narrow": lambda t: _rewrapped(t, 50),
    }[form]
    assert len(TEXTS) == len(licences.RULES)
    rows = [(i, put(t)) for i, t in enumerate(TEXTS)]
    got = {r.doc_id: (r.rule, r.licence) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (i, name) for i, (name, _) in enumerate(licences.RULES)}
