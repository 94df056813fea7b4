"""Wording of public licences and licence notices as templates.

Mark-up: ``<<beginOptional>> .. <<endOptional>>`` may be absent as a whole (nested ones too), ``<<var;words=m-n>>``
stands for any m to n words.  Everything else is mandatory wording; case, punctuation and line breaks do not count.
"""

from __future__ import annotations

PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

_AS_IS_BSD = """
THIS SOFTWARE IS PROVIDED BY <<var;words=1-12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;words=1-12>> BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE
"""
_BSD_TWO = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: <<beginOptional>>1<<endOptional>> Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. <<beginOptional>>2<<endOptional>> Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
with the distribution.
"""
_BSD_THIRD = """
<<beginOptional>>3<<endOptional>> Neither the name of <<var;words=1-12>> nor the names of its contributors may be used to endorse
or promote products derived from this software without specific prior written permission.
"""
_GNU = """
This <<beginOptional>>program<<endOptional>><<beginOptional>>library<<endOptional>><<beginOptional>>file<<endOptional>> is free
software<<beginOptional>>;<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU {name} as published by
the Free Software Foundation; either version {version} of the License, <<beginOptional>>or (at your option) any later
version<<endOptional>>
"""
_NOTICE = "<<beginOptional>>terms of the<<endOptional>> <<beginOptional>>terms and conditions of the<<endOptional>>"
_UNDER = f"under the {_NOTICE}"

TEMPLATES = [
    ("mit", """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do
so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next
paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS",
WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;words=1-12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE
"""),
    ("bsd-2-clause", _BSD_TWO + _AS_IS_BSD),
    ("bsd-3-clause", _BSD_TWO + _BSD_THIRD + _AS_IS_BSD),
    ("isc", """
Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee
is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND <<var;words=1-12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;words=1-12>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE
"""),
    ("zlib", """
This software is provided 'as-is', without any express or implied warranty. In no event will the <<var;words=1-6>> be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
<<beginOptional>>1<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the
original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
not required. <<beginOptional>>2<<endOptional>> Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. <<beginOptional>>3<<endOptional>> This notice may not be removed or altered from any
source distribution
"""),
    ("apache-2.0", """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this <<var;words=1-4>> except in compliance with the
License. You may obtain a copy of the License at <<var;words=0-10>> Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License
"""),
    ("apache-2.0", f"Licensed {_UNDER} Apache License<<beginOptional>>,<<endOptional>> <<beginOptional>>version<<endOptional>> 2.0"),
    ("mit", f"licensed {_UNDER} MIT License"),
    ("mit", f"released {_UNDER} MIT License"),
    ("gpl-2.0", _GNU.format(name="General Public License", version="2")),
    ("gpl-3.0", _GNU.format(name="General Public License", version="3")),
    ("lgpl-2.1", _GNU.format(name="Lesser General Public License", version="2.1")),
    ("lgpl-3.0", _GNU.format(name="Lesser General Public License", version="3")),
    ("agpl-3.0", _GNU.format(name="Affero General Public License", version="3")),
    ("gpl-2.0", f"licensed {_UNDER} GNU General Public License<<beginOptional>>, version<<endOptional>> 2"),
    ("gpl-3.0", f"licensed {_UNDER} GNU General Public License<<beginOptional>>, version<<endOptional>> 3"),
    ("mpl-2.0", """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at
"""),
    ("unlicense", """
This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and
by any means
"""),
    *[(f"cc-{kind}-{version}", f"licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> "
                               f"<<beginOptional>>Creative Commons<<endOptional>> CC {kind.replace('-', ' ')} {version}")
      for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd") for version in ("3.0", "4.0")],
]
