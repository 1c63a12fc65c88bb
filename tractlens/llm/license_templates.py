"""Licence templates in SPDX-style markup, compiled to token automata.

Markup: ``<<optional>>...<<end>>`` may be absent as a whole (nesting allowed);
``<<var>>`` stands for any number of arbitrary words (one looping state), ``<<var max=N>>``
for 0 to N of them.  Everything else is mandatory wording, compared word by word after lower-casing A-Z, where words are
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from tractlens.llm.common import ALNUM_LOWER

#: Public licence wordings by label.
TEMPLATES: list[tuple[str, str]] = [
    ("mit", """<<optional>>The <<end>><<optional>>MIT License<<optional>> (MIT)<<end>><<end>>
<<optional>>Copyright <<var>><<end>>
Permission is hereby granted, free of charge, to any person obtaining a copy of <<var max=8>> (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice
<<optional>>(including the next paragraph) <<end>>shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
<<var>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mit", "<<optional>>This <<var max=6>> is <<end>>released under the <<optional>>terms of the <<end>>MIT License"),
    ("mit", "licensed under the <<optional>>terms of the <<end>>MIT License"),
    ("isc", """Permission to use, copy, modify, and<<optional>>/or<<end>> distribute this software for any purpose with or
without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND <<var>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: <<var max=2>> Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. <<var max=2>> Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution. 
THIS SOFTWARE IS PROVIDED BY <<var>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var>> BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT
OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: <<var max=2>> Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. <<var max=2>> Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution. <<var max=2>> Neither the name of <<var>> nor the names of its contributors may be
used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY <<var>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var>> BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT
OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
<<var max=1>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
<<var max=1>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software. <<var max=1>> This notice may not be removed or altered from any source distribution."""),
    ("apache-2.0", """<<optional>>This <<var max=6>> is <<end>>licensed under the <<optional>>terms of the <<end>>Apache License,
Version 2.0<<optional>> (the "License"); you may not use this file except in compliance with the License. You may obtain a
copy of the License at <<optional>>http<<optional>>s<<end>>://www.apache.org/licenses/LICENSE-2.0<<end>><<end>>"""),
    ("gpl-2.0", """<<optional>>This <<var max=6>> is <<end>>licensed under the <<optional>>terms of the <<end>>GNU General Public
License, version 2<<optional>>.0<<end>><<optional>> or later<<end>>"""),
    ("gpl-3.0", """<<optional>>This <<var max=6>> is <<end>>licensed under the <<optional>>terms of the <<end>>GNU General Public
License, version 3<<optional>>.0<<end>><<optional>> or later<<end>>"""),
    ("gpl-notice", """This program is free software<<optional>>:<<end>> you can redistribute it and/or modify it under the terms
of the GNU General Public License as published by the Free Software Foundation<<optional>>, either<<end>> version
<<var max=1>> of the License<<optional>>, or (at your option) any later version<<end>>"""),
    ("lgpl", "licensed under the <<optional>>terms of the <<end>>GNU Lesser General Public License"),
    ("agpl", "licensed under the <<optional>>terms of the <<end>>GNU Affero General Public License"),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial
or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software
dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the
public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS
IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR
A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""),
    ("cc0", "<<optional>>dedicated to the public domain <<end>>under <<optional>>the <<end>>CC0 1.0"),
    ("cc-by", "licensed under <<optional>>a <<end>><<optional>>the <<end>>CC BY <<var max=1>>.0"),
    ("cc-by-sa", "licensed under <<optional>>a <<end>><<optional>>the <<end>>CC BY-SA <<var max=1>>.0"),
    ("cc-by-nc", "licensed under <<optional>>a <<end>><<optional>>the <<end>>CC BY-NC <<var max=1>>.0"),
    ("cc-by-nd", "licensed under <<optional>>a <<end>><<optional>>the <<end>>CC BY-ND <<var max=1>>.0"),
]
_MARK = re.compile(r"<<(optional|end|var(?: max=(\d+))?)>>")
#: The step of a state that any word leads back to.
LOOP = True


def words_of(text: str | bytes) -> list[bytes]:
    b = text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
    return b.translate(ALNUM_LOWER).split()


@dataclass(frozen=True)
class Automaton:
    """States are positions between tokens; ``eps`` skips optional regions and variables.

    ``step[s]`` is a word that leads from s to s+1, or None for any word (a slot
    of a bounded variable), or LOOP where any word leads back to s (an unbounded one).
    """

    label: str
    step: list
    eps: list
    closure: list
    anchor: bytes
    wording: int

    @property
    def end(self) -> int:
        return len(self.step)


def compile_template(label: str, markup: str) -> Automaton:
    step: list = []
    eps: list[set[int]] = [set()]
    open_at: list[int] = []
    runs, run = [], []

    def push(w) -> None:
        step.append(w)
        eps.append(set())

    at = 0
    for m in [*_MARK.finditer(markup), None]:
        for w in words_of(markup[at : m.start() if m else None]):
            push(w)
            if not open_at:
                run.append(w)
        if m is None:
            break
        at = m.end()
        runs.append(run)
        run = []
        if m[1] == "optional":
            open_at.append(len(step))
        elif m[1] == "end":
            eps[open_at.pop()].add(len(step))
        elif m[2] is None:
            eps[-1].add(len(step) + 1)
            push(LOOP)
        else:
            first = len(step)
            for _ in range(int(m[2])):
                push(None)
            for s in range(first, len(step)):
                eps[s].add(len(step))
    runs.append(run)
    if open_at:
        raise ValueError(f"{label}: an optional region has no end")
    anchor = max(runs, key=len)
    if not anchor:
        raise ValueError(f"{label}: no mandatory wording")
    closure = []
    for s in range(len(step) + 1):
        seen, todo = {s}, [s]
        while todo:
            for x in eps[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        closure.append(tuple(sorted(seen)))
    return Automaton(label, step, eps, closure, b" " + b" ".join(anchor) + b" ", sum(w is not None and w is not LOOP for w in step))


def accept(a: Automaton, words: list[bytes]) -> list[tuple[int, int, int]]:
    """Non-overlapping accepted ranges ``(start, end, wording words matched)``, leftmost and then longest first."""
    found: list[tuple[int, int, int]] = []
    live: dict[int, tuple[int, int]] = {}  # state: (start, minus the wording matched), the best is the least
    begins = a.closure[0]
    for i, w in enumerate(words):
        for s in begins:
            if a.step[s : s + 1] == [w] and (s not in live or live[s] > (i, 0)):
                live[s] = (i, 0)
        after: dict[int, tuple[int, int]] = {}
        for s, (start, neg) in live.items():
            want = a.step[s] if s < a.end else b""
            if want is None or want is LOOP or want == w:
                best = (start, neg - (want is not None and want is not LOOP))
                for t in a.closure[s if want is LOOP else s + 1]:
                    if t not in after or after[t] > best:
                        after[t] = best
        if a.end in after:
            start, neg = after.pop(a.end)
            if -neg > 0:
                found.append((start, i + 1, -neg))
        live = after
    out: list[tuple[int, int, int]] = []
    for start, end, n in sorted(found, key=lambda x: (x[0], -x[2], x[1])):
        if not out or start >= out[-1][1]:
            out.append((start, end, n))
    return out
