"""Public licence texts and one-sentence grants, by their public identifiers.

The longer licences are whole files in ``license_files``, as their stewards publish them.
"""

import re
from pathlib import Path

_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""

_ZLIB_BODY = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

"""
_0BSD_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

"""

_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""

_BSD_NAMES = "3. Neither the name of {} nor the names of {} contributors may be used to endorse or promote products derived from this software without specific prior written permission."

_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE {} AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE {} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as
a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF
OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>"""

_BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the
Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a
source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT
HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_NEITHER = [("the copyright holder", "its"), ("the copyright holders", "its"), ("the University", "its"), ("the author", "its"), ("the organization", "its")]
#: Who provides the software and who is not liable.
_BY = [("COPYRIGHT HOLDERS", "COPYRIGHT HOLDER"), ("COPYRIGHT HOLDERS", "COPYRIGHT OWNER"), ("COPYRIGHT HOLDER", "COPYRIGHT HOLDER"), ("AUTHOR", "AUTHOR"), ("REGENTS", "REGENTS")]
_TITLES = {"BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"]}


def _bsd() -> list[tuple[str, str]]:
    """The two BSD licences with the holders' names that are in use."""
    found = []
    for by in _BY:
        end = _BSD_WARRANTY.format(*by)
        found.append(("BSD-2-Clause", f"{_BSD_START}\n\n{end}"))
        found += [("BSD-3-Clause", f"{_BSD_START}\n\n{_BSD_NAMES.format(*names)}\n\n{end}") for names in _NEITHER]
    bare = [(name, re.sub(r"(?m)^[123]\. ", "", text)) for name, text in found]  # bullets in place of numbers
    found += bare
    return found + [(name, f"{title}\n\n{text}") for name, text in found for title in _TITLES[name]]


FILES = [(path.stem, path.read_text("utf-8")) for path in sorted((Path(__file__).parent / "license_files").glob("*.txt"))]


def _files() -> list[tuple[str, str]]:
    """Each whole file, and the same without its title, its appendix or both."""
    found = []
    for name, text in FILES:
        body = re.split(r"END OF TERMS AND CONDITIONS|\n[ \t]*APPENDIX:|\nADDENDUM:|\nEXHIBIT A -", text)[0]
        marked = re.match(r"(?s).*END OF TERMS AND CONDITIONS", text)
        whole = [text, body, *([marked[0]] if marked else [])]
        found += [(name, x) for t in whole for x in (t, re.split(r"\n[ \t]*\n", t.strip(), maxsplit=1)[1])]
    return found


SHORT = [
    ("MIT", _MIT_BODY),
    ("MIT", "MIT License\n\n" + _MIT_BODY),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT_BODY),
    ("MIT", "The MIT License\n\n" + _MIT_BODY),
    ("ISC", _ISC_GRANT + _ISC_WARRANTY),
    ("ISC", "ISC License\n\n" + _ISC_GRANT + _ISC_WARRANTY),
    ("ISC", "The ISC License\n\n" + _ISC_GRANT + _ISC_WARRANTY),
    ("ISC", "ISC License (ISC)\n\n" + _ISC_GRANT + _ISC_WARRANTY),
    ("0BSD", _0BSD_GRANT + _ISC_WARRANTY),
    ("0BSD", "BSD Zero Clause License\n\n" + _0BSD_GRANT + _ISC_WARRANTY),
    ("0BSD", "Zero-Clause BSD\n\n" + _0BSD_GRANT + _ISC_WARRANTY),
    ("Zlib", _ZLIB_BODY),
    ("Zlib", "zlib License\n\n" + _ZLIB_BODY),
    ("Zlib", "The zlib License\n\n" + _ZLIB_BODY),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE.replace("https://unlicense.org/", "http://unlicense.org")),
    ("Unlicense", "The Unlicense\n\n" + _UNLICENSE),
    ("BSL-1.0", _BOOST),
    ("BSL-1.0", _BOOST.split("\n\n", 1)[1]),
    *_bsd(),
]
LICENSES = SHORT + _files()

NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
]
