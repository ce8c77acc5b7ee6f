"""What licences are known by: the full texts in `licences/`, shorter texts, and notices.

Names are SPDX identifiers, without "-only" and "-or-later".
"""

from __future__ import annotations

import re
from functools import lru_cache
from importlib.resources import files

# Licences whose texts are files of that name.
FILES = (
    "Apache-2.0 Artistic-1.0-Perl CC0-1.0 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0"
    " MPL-1.1 MPL-2.0"
).split()

# The wording of short licences.
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT_START = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_END = """The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
_ISC_START = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted"""
_ISC_COPIES = "provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
SHORT: tuple[tuple[str, str], ...] = (
    ("MIT", f"{_MIT_START} {_MIT_END}"),
    ("MIT", _MIT_START),
    ("BSD-2-Clause", f"{_BSD_START} {_BSD_END}"),
    ("BSD-2-Clause", _BSD_START),
    ("BSD-3-Clause", f"{_BSD_START} {_BSD_NAMES} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_START} {_BSD_NAMES}"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", f"{_ISC_START}, {_ISC_COPIES} {_ISC_END}"),
    ("ISC", f"{_ISC_START}, {_ISC_COPIES}"),
    ("0BSD", f"{_ISC_START}. {_ISC_END}"),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held"
        " liable for any damages arising from the use of this software. Permission is granted to anyone to use this"
        " software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject"
        " to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that"
        " you wrote the original software. If you use this software in a product, an acknowledgment in the product"
        " documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as"
        " such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered"
        " from any source distribution.",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and"
        " accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute,"
        " execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties"
        " to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software"
        " and this entire statement, including the above license grant, this restriction and the following disclaimer, must"
        " be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless"
        " such copies or derivative works are solely in the form of machine-executable object code generated by a source"
        " language processor.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,"
        " use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any"
        " purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the"
        " author or authors of this software dedicate any and all copyright interest in the software to the public domain."
        " We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors."
        " We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to"
        " this software under copyright law.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

# Notices that name a licence.
NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance"
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless"
        " required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
        ' "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the'
        " specific language governing permissions and limitations under the License.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance"
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Proprietary", "All rights reserved."),
)
# Licences of one family, in words.
GNU = {"GPL": "General Public License", "LGPL": "Lesser General Public License", "AGPL": "Affero General Public License"}
CREATIVE = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_AFFERO = """13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of
this License, if you modify the Program, your modified version must prominently offer all users interacting with it
remotely through a computer network (if your version supports such interaction) an opportunity to receive the
Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge,
through some standard or customary means of facilitating copying of software. This Corresponding Source shall include the
Corresponding Source for any work covered by version 3 of the GNU General Public License that is incorporated pursuant to
the following paragraph. Notwithstanding any other provision of this License, you have permission to link or combine any
covered work with a work licensed under version 3 of the GNU General Public License into a single combined work, and to
convey the resulting work. The terms of this License will continue to apply to the part which is the covered work, but
the work with which it is combined will remain governed by version 3 of the GNU General Public License."""


def _text(name: str) -> str:
    return (files("wordloom.llm") / "licences" / f"{name}.txt").read_text("utf-8")


def _affero() -> str:
    """The GPL with its name and section 13 changed."""
    rest, _, end = _text("GPL-3.0").partition("13. Use with the GNU Affero General Public License.")
    end = "14. Revised Versions" + end.partition("14. Revised Versions")[2]
    named = lambda t: re.sub(r"GNU\s+General", "GNU Affero General", t)
    return f"{named(rest)} {_AFFERO} {named(end)}"


def _gnu() -> list[tuple[str, str]]:
    out = []
    for short, words in GNU.items():
        own, work = ("library", "Library") if short == "LGPL" else ("program", "Program")
        for version in ("2.0", "2.1", "3.0"):
            if short != "LGPL" and version == "2.1" or short == "AGPL" and version != "3.0":
                continue
            number = version.removesuffix(".0")
            named = f"GNU {'Library General Public License' if (short, number) == ('LGPL', '2') else words}"
            name = f"{short}-{version}"
            out.append((name, f"This work is licensed under the {named}, version {number}."))
            out.append((name, f"Licensed under the {named}, version {number}."))
            for thing in {own, "program"}:
                out.append((
                    name,
                    f"This {thing} is free software; you can redistribute it and/or modify it under the terms of the {named} as"
                    f" published by the Free Software Foundation; either version {number} of the License, or (at your option) any"
                    " later version.",
                ))
    return out


def _creative() -> list[tuple[str, str]]:
    out = []
    for short, words in CREATIVE.items():
        for version, port in (("4.0", "International"), ("3.0", "Unported")):
            name = f"CC-{short}-{version}"
            out.append((name, f"Licensed under CC {short} {version}."))
            out.append((name, f"This work is licensed under a Creative Commons {words} {version} {port} License."))
    return out


@lru_cache(maxsize=1)
def templates() -> tuple[tuple[str, str], ...]:
    """(licence, text) of all texts and notices. Cached in a worker."""
    out = [*NOTICES, *_gnu(), *_creative(), *SHORT, ("AGPL-3.0", _affero()), *((name, _text(name)) for name in FILES)]
    names = dict.fromkeys(name for name, _ in out if name != "Proprietary")
    return (*out, *((name, f"SPDX-License-Identifier: {name}") for name in names))
