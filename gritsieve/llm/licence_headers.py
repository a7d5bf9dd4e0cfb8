"""Standard headers, notices and short texts of licences, as fixed values."""

from pathlib import Path

TEXTS = Path(__file__).with_name("licence_texts")
GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    " documentation files (the \"Software\"), to deal in the Software without restriction, including without"
    " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
    " Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions"
    " of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING"
    " BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN"
    " NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN"
    " AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR"
    " OTHER DEALINGS IN THE SOFTWARE."
)
BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this"
    " list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above"
    " copyright notice, this list of conditions and the following disclaimer in the documentation and/or other"
    " materials provided with the distribution."
)
BSD_NAMES = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission."
)
BSD_REST = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED"
    " WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A"
    " PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY"
    " DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,"
    " PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER"
    " CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR"
    " OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(name: str, version: str) -> str:
    return (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
        f" {name} General Public License as published by the Free Software Foundation, either version {version} of the"
        " License, or (at your option) any later version."
    )


def _gnu_rest(name: str) -> str:
    return (
        " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the"
        " implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU"
        f" {name} General Public License for more details."
        f" You should have received a copy of the GNU {name} General Public License along with this program. If not,"
        " see <https://www.gnu.org/licenses/>."
    )


GNU = {"GPL-3.0": ("", "3"), "GPL-2.0": ("", "2"), "LGPL-3.0": ("Lesser", "3"), "LGPL-2.1": ("Lesser", "2.1"), "AGPL-3.0": ("Affero", "3")}
APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance"
    " with the License. You may obtain a copy of the License at"
)
APACHE_REST = (
    " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software"
    " distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,"
    " either express or implied. See the License for the specific language governing permissions and limitations"
    " under the License."
)
#: (licence, text) of headers and short texts, whole and by the paragraph that names or grants.
HEADERS = [
    ("MIT", GRANT), ("MIT", f"{GRANT} {MIT_REST}"), ("MIT", "MIT License"), ("MIT", "The MIT License (MIT)"),
    ("Apache-2.0", APACHE), ("Apache-2.0", APACHE + APACHE_REST),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("BSD-2-Clause", BSD_2 + BSD_REST), ("BSD-3-Clause", BSD_2 + BSD_NAMES + BSD_REST),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2 Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the"
     " MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
     " hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy,"
     " modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled"
     " binary, for any purpose, commercial or non-commercial, and by any means."),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    *((name, _gnu(*of)) for name, of in GNU.items()),
    *((name, _gnu(*of) + _gnu_rest(of[0])) for name, of in GNU.items()),
]
#: The title that has to stand first in a whole text besides: texts of one family are alike.
TITLES = {
    "Apache-2.0": "apache license version 2 0", "GPL-2.0": "gnu general public license version 2",
    "GPL-3.0": "gnu general public license version 3", "LGPL-2.1": "gnu lesser general public license version 2 1",
    "LGPL-3.0": "gnu lesser general public license version 3", "MPL-2.0": "mozilla public license version 2 0",
    "CC0-1.0": "cc0 1 0 universal",
}


def whole_texts() -> list[tuple[str, str]]:
    return [(name, (TEXTS / f"{name}.txt").read_text(encoding="utf-8")) for name in TITLES]
