"""Texts of the licences of licence.TEMPLATES as files bear them: standard headers, short notices,
tags, and the licence text (of the four long ones the opening, which a licence file begins with)."""

from __future__ import annotations

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_ASF = """Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to you under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"""
_APACHE_OPENING = """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/
TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_MPL_OPENING = """Mozilla Public License Version 2.0
1. Definitions
1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.
1.2. "Contributor Version" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor's Contribution."""


def _gnu(kind: str, short: str) -> list[str]:
    header = f"""This program is free software: you can redistribute it and/or modify it under the terms of the {kind} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {kind} for more details.
You should have received a copy of the {kind} along with this program. If not, see <https://www.gnu.org/licenses/>."""
    first = "The GNU General Public License is a free, copyleft license for software and other kinds of works." if short == "GPL" else "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."
    opening = f"""{kind} Version 3, {"29 June" if short == "GPL" else "19 November"} 2007
Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.
Preamble
{first}"""
    notices = [f"Licensed under the {kind} v3.0", f"Licensed under the {kind} version 3", f"{kind} version 3", f"This work is licensed under the {kind}, version 3.", f"Released under the {short}-3.0 license", f"Licensed under the {short}v3 license"]
    tags = [f"SPDX-License-Identifier: {short}-3.0{end}" for end in ("", "-only", "-or-later", "+")]
    return [header, opening, *notices, *tags]


def _cc(kind: str, short: str) -> list[str]:
    whole = f"Creative Commons {kind} 4.0 International"
    return [
        f"This work is licensed under a {whole} License.",
        f"This work is licensed under the {whole} License. To view a copy of this license, visit http://creativecommons.org/licenses/{short.lower()}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
        f"{whole} Public License By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this {whole} Public License (\"Public License\").",
        f"Licensed under CC {short} 4.0.",
        f"This work is licensed under CC {short} 4.0",
        f"License: CC-{short}-4.0",
        f"SPDX-License-Identifier: CC-{short}-4.0",
    ]


#: Several texts of each licence, by SPDX id.
TEXTS = {
    "AGPL-3.0": _gnu("GNU Affero General Public License", "AGPL"),
    "Apache-2.0": [_APACHE, _ASF, _ASF + _APACHE[_APACHE.index("\n") :], _APACHE_OPENING, "Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0", "Apache License 2.0", "License: Apache-2.0", "Licensed under the Apache 2.0 license", "SPDX-License-Identifier: Apache-2.0"],
    "BSD-3-Clause": [_BSD, _BSD[_BSD.index("1.") :], "BSD 3-Clause License", "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License.", "Licensed under the BSD 3-Clause License", "Released under the BSD-3-Clause license", "License: BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": _cc("Attribution", "BY"),
    "CC-BY-NC-4.0": _cc("Attribution-NonCommercial", "BY-NC"),
    "GPL-3.0": _gnu("GNU General Public License", "GPL"),
    "MIT": ["MIT License " + _MIT, _MIT, "Released under the MIT License.", "MIT License", "The MIT License (MIT)", "Licensed under the MIT License", "This project is licensed under the MIT License", "Use of this source code is governed by an MIT-style license", "License: MIT", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": [_MPL, _MPL_OPENING, "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "Licensed under the Mozilla Public License 2.0", "Mozilla Public License Version 2.0", "License: MPL-2.0", "SPDX-License-Identifier: MPL-2.0"],
}

#: What the words of a passage, joined by spaces, must hold: cosines alone can't tell a version or a
#: sister licence, which differ from these texts in one word.
MARKS = {
    "AGPL-3.0": r"affero general public license.*\b(version 3|v3|3\.0)\b|\bagpl[- ]?v?3",
    "Apache-2.0": r"\bapache (software )?(license )?(version )?v?2(\.0)?\b|\bapache-2\.0\b|apache\.org licenses license-2\.0",
    "BSD-3-Clause": r"\bbsd[- ]3-clause\b|\b3-clause bsd\b|redistributions? .*neither the names? of",
    "CC-BY-4.0": r"creative commons attribution 4\.0|\bcc[- ]by[- ]4\.0",
    "CC-BY-NC-4.0": r"creative commons attribution-noncommercial 4\.0|\bcc[- ]by-nc[- ]4\.0",
    "GPL-3.0": r"gnu general public license.*\b(version 3|v3|3\.0)\b|(^|[^a-z])gpl[- ]?v?3",
    "MIT": r"\bmit\b|permission is hereby granted free of charge to any person obtaining a copy of this software",
    "MPL-2.0": r"mozilla public license (version |v )?2\.0|\bmpl[- ]2\.0\b",
}
