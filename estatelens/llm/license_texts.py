"""Licence wording with template markup: whole public licence texts and the notices that stand for longer ones.

Wording, labels and their options are fixed values.
"""

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"""
_OR_OTHERWISE = """TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT = f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software <<beginOptional>>and associated
documentation files<<endOptional>> (the "<<var;match="Software|Materials">>"), to deal in the <<var;match="Software|Materials">> without
restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
<<var;match="Software|Materials">>, and to permit persons to whom the <<var;match="Software|Materials">> <<var;match="is|are">> furnished to
do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next
paragraph)<<endOptional>> shall be included in all copies or substantial portions of the <<var;match="Software|Materials">>. {_AS_IS} AND
NONINFRINGEMENT. IN NO EVENT SHALL <<var;match=".{{1,8}}">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, {_OR_OTHERWISE}"""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: <<beginOptional>>1<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. <<beginOptional>>2<<endOptional>> Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """<<beginOptional>>3<<endOptional>> Neither the name of <<var;match=".{1,12}">> nor the names of its contributors may be used to
endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY <<var;match=".{1,8}">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;match=".{1,8}">> BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER
IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_KEPT = ", provided that the above copyright notice and this permission notice appear in all copies"
_ISC_END = """. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;match=".{1,6}">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;match=".{1,6}">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will <<var;match=".{1,6}">> be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
<<beginOptional>>1<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an <<var;match="acknowledgment|acknowledgement">> in the product documentation would be
appreciated but is not required. <<beginOptional>>2<<endOptional>> Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. <<beginOptional>>3<<endOptional>> This notice may not be removed or altered from any source
distribution."""
_BOOST = f"""Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to
prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the
following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless
such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. {_AS_IS},
TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER
LIABILITY, WHETHER IN CONTRACT, {_OR_OTHERWISE}"""
_UNLICENSE = f"""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all
copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment
of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to
this software under copyright law. {_AS_IS} AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, {_OR_OTHERWISE} <<beginOptional>>For more information, please refer to <<var;match=".{{1,6}}">>
<<endOptional>>"""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this <<var;match=".{1,4}">> except in
compliance with the License. You may obtain a copy of the License at <<var;match="http www apache org licenses license 2 0|https www apache
org licenses license 2 0">> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""


def _gnu_notice(name: str, version: str) -> str:
    return f"""This <<var;match="program|library|file|software">> is free software<<beginOptional>>:<<endOptional>> you can redistribute it
        and/or modify it under the terms of the GNU {name} License as published by the Free Software Foundation; either version {version} of the
        License, or (at your option) any later version. This <<var;match="program|library|file|software">> is distributed in the hope that it will
        be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        {name} License for more details."""


_VERB = '<<var;match="licensed|released|distributed|made available|available|published|provided">>'
_WORK = '<<beginOptional>><<var;match="this|the">> <<var;match=".{1,3}">> is<<endOptional>>'


def _notice(name: str) -> str:
    return f"{_WORK} {_VERB} under <<beginOptional>>the terms of<<endOptional>> {name}"


_VERSION = "<<beginOptional>>version<<endOptional>>"
TEMPLATES = [
    ("mit", _MIT), ("bsd-2-clause", f"{_BSD_2} {_BSD_END}"), ("bsd-3-clause", f"{_BSD_2} {_BSD_3} {_BSD_END}"), ("isc", _ISC + _ISC_KEPT + _ISC_END), ("0bsd", _ISC + _ISC_END),
    ("zlib", _ZLIB), ("bsl-1.0", _BOOST), ("unlicense", _UNLICENSE), ("apache-2.0", _APACHE_NOTICE),
    ("gpl-2.0-or-later", _gnu_notice("General Public", "2")), ("gpl-3.0-or-later", _gnu_notice("General Public", "3")), ("lgpl-2.1-or-later", _gnu_notice("Lesser General Public", "2.1")),
    ("lgpl-3.0-or-later", _gnu_notice("Lesser General Public", "3")), ("agpl-3.0-or-later", _gnu_notice("Affero General Public", "3")),
    ("mit", _notice('the <<var;match="mit|expat|x11">> license')), ("apache-2.0", _notice(f"the apache <<beginOptional>>software<<endOptional>> license {_VERSION} 2 <<beginOptional>>0<<endOptional>>")),
    ("gpl-2.0", _notice(f"the gnu general public license {_VERSION} 2")), ("gpl-3.0", _notice(f"the gnu general public license {_VERSION} 3")), ("lgpl-3.0", _notice(f"the gnu lesser general public license {_VERSION} 3")),
    ("mpl-2.0", """this source code form is subject to the terms of the mozilla public license <<beginOptional>>v|version<<endOptional>> 2 0 <<beginOptional>>if a copy of
        the mpl was not distributed with this file you can obtain one at <<var;match=".{1,6}">><<endOptional>>"""),
    ("cc-by-nc-4.0", _notice('<<beginOptional>>a|the<<endOptional>> <<var;match="cc by nc|creative commons attribution noncommercial|creative commons attribution non commercial">> 4 0')),
    ("cc-by-4.0", _notice('<<beginOptional>>a|the<<endOptional>> <<var;match="cc by|creative commons attribution">> 4 0')),
    ("proprietary", 'all rights reserved <<beginOptional>><<var;match=".{0,8}">><<endOptional>> unauthorized copying'),
]
