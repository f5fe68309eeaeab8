"""Known licence sentences and the ordered rules over their identifiers."""

from __future__ import annotations

#: Fixed values: (identifier, sentence); several wordings may share an identifier.  Case and punctuation don't count.
SENTENCES: list[tuple[str, str]] = [
    # MIT and its kin
    ("MIT-NOTICE", "Released under the MIT License."),
    ("MIT-LICENSED", "Licensed under the MIT License."),
    ("MIT-LICENSED", "This project is licensed under the MIT License."),
    ("MIT-TITLE", "The MIT License (MIT)"),
    ("MIT-TITLE", "The MIT License"),
    ("MIT-TITLE", "MIT License"),
    ("MIT-GRANT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT-CONDITION", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT-WARRANTY", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("MIT-WARRANTY", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NON-INFRINGEMENT.'),
    ("MIT-LIABILITY", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC-TITLE", "ISC License"),
    ("ISC-TITLE", "The ISC License"),
    ("ISC-GRANT", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC-GRANT", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD-GRANT", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("ISC-WARRANTY", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("X11-NAME", "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium."),
    # BSD
    ("BSD-GRANT", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-SOURCE", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-BINARY", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-ADVERTISING", "All advertising materials mentioning features or use of this software must display the following acknowledgement:"),
    ("BSD-NAMES", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-NAMES", "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-NAMES", "Neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-NAMES", "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-WARRANTY", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("BSD-NOTICE", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-TITLE", "BSD 2-Clause License"),
    ("BSD-3-TITLE", "BSD 3-Clause License"),
    # Apache
    ("APACHE-TITLE", "Apache License Version 2.0, January 2004"),
    ("APACHE-NOTICE", "Licensed under the Apache License, Version 2.0."),
    ("APACHE-GRANT", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("APACHE-ASF", 'The ASF licenses this file to You under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("APACHE-COMPLIANCE", "You may not use this file except in compliance with the License."),
    ("APACHE-COPY", "You may obtain a copy of the License at"),
    ("APACHE-BASIS", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("APACHE-SEE", "See the License for the specific language governing permissions and limitations under the License."),
    # Mozilla, Eclipse, European Union, Boost, zlib, Perl, Python
    ("MPL2-FORM", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL2-COPY", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL2-COPY", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL2-SECONDARY", 'This Source Code Form is "Incompatible With Secondary Licenses", as defined by the Mozilla Public License, v. 2.0.'),
    ("MPL2-TITLE", "Mozilla Public License Version 2.0"),
    ("MPL11-GRANT", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.'),
    ("EPL2-GRANT", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("EPL2-GRANT", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at"),
    ("EPL1-GRANT", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at"),
    ("EUPL-GRANT", 'Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the "Licence");'),
    ("BOOST-NOTICE", "Distributed under the Boost Software License, Version 1.0."),
    ("BOOST-TITLE", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BOOST-COPY", "See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt"),
    ("ZLIB-WARRANTY", "This software is provided 'as-is', without any express or implied warranty."),
    ("ZLIB-GRANT", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("PERL-GRANT", "This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself."),
    ("PERL-GRANT", "This program is free software; you can redistribute it and/or modify it under the same terms as Perl itself."),
    ("PSF-GRANT", "This software is licensed under the Python Software Foundation License Version 2."),
    # Public domain
    ("UNLICENSE-FREE", "This is free and unencumbered software released into the public domain."),
    ("CC0-WAIVER", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("CC0-WAIVER", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."),
    ("CC0-TITLE", "CC0 1.0 Universal Public Domain Dedication"),
    ("PD-NOTICE", "This file is in the public domain."),
    ("PD-NOTICE", "This work is in the public domain."),
    # None granted
    ("ALL-RIGHTS", "All rights reserved."),
]
#: Fixed values: (rule, licence, identifiers in order).
RULES: list[tuple[str, str, list[str]]] = [
    ("mit-notice", "MIT", ["MIT-NOTICE"]),
    ("mit-licensed", "MIT", ["MIT-LICENSED"]),
    ("mit-title", "MIT", ["MIT-TITLE"]),
    ("mit-text", "MIT", ["MIT-GRANT", "MIT-CONDITION"]),
    ("mit-whole-text", "MIT", ["MIT-GRANT", "MIT-CONDITION", "MIT-WARRANTY", "MIT-LIABILITY"]),
    ("mit-0-text", "MIT-0", ["MIT-GRANT", "MIT-WARRANTY", "MIT-LIABILITY"]),
    ("x11-text", "X11", ["MIT-GRANT", "MIT-CONDITION", "MIT-WARRANTY", "X11-NAME"]),
    ("isc-title", "ISC", ["ISC-TITLE"]),
    ("isc-grant", "ISC", ["ISC-GRANT"]),
    ("isc-text", "ISC", ["ISC-GRANT", "ISC-WARRANTY"]),
    ("0bsd-text", "0BSD", ["0BSD-GRANT", "ISC-WARRANTY"]),
    ("bsd-1-text", "BSD-1-Clause", ["BSD-GRANT", "BSD-SOURCE", "BSD-WARRANTY"]),
    ("bsd-text", "BSD-2-Clause", ["BSD-GRANT", "BSD-SOURCE", "BSD-BINARY"]),
    ("bsd-3-text", "BSD-3-Clause", ["BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-NAMES"]),
    ("bsd-4-text", "BSD-4-Clause", ["BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-ADVERTISING", "BSD-NAMES"]),
    ("bsd-notice", "LicenseRef-BSD-style", ["BSD-NOTICE"]),
    ("bsd-2-title", "BSD-2-Clause", ["BSD-2-TITLE"]),
    ("bsd-3-title", "BSD-3-Clause", ["BSD-3-TITLE"]),
    ("apache-notice", "Apache-2.0", ["APACHE-NOTICE"]),
    ("apache-header", "Apache-2.0", ["APACHE-NOTICE", "APACHE-COMPLIANCE", "APACHE-COPY"]),
    ("apache-header-text", "Apache-2.0", ["APACHE-GRANT", "APACHE-COPY"]),
    ("apache-whole-header", "Apache-2.0", ["APACHE-GRANT", "APACHE-COPY", "APACHE-BASIS", "APACHE-SEE"]),
    ("apache-asf-header", "Apache-2.0", ["APACHE-ASF", "APACHE-COPY"]),
    ("apache-title", "Apache-2.0", ["APACHE-TITLE"]),
    ("mpl-2-notice", "MPL-2.0", ["MPL2-FORM"]),
    ("mpl-2-header", "MPL-2.0", ["MPL2-FORM", "MPL2-COPY"]),
    ("mpl-2-no-copyleft", "MPL-2.0-no-copyleft-exception", ["MPL2-FORM", "MPL2-COPY", "MPL2-SECONDARY"]),
    ("mpl-2-title", "MPL-2.0", ["MPL2-TITLE"]),
    ("mpl-1.1-header", "MPL-1.1", ["MPL11-GRANT"]),
    ("epl-2-header", "EPL-2.0", ["EPL2-GRANT"]),
    ("epl-1-header", "EPL-1.0", ["EPL1-GRANT"]),
    ("eupl-header", "EUPL-1.2", ["EUPL-GRANT"]),
    ("boost-notice", "BSL-1.0", ["BOOST-NOTICE"]),
    ("boost-header", "BSL-1.0", ["BOOST-NOTICE", "BOOST-COPY"]),
    ("boost-title", "BSL-1.0", ["BOOST-TITLE"]),
    ("zlib-text", "Zlib", ["ZLIB-WARRANTY", "ZLIB-GRANT"]),
    ("perl-notice", "Artistic-1.0-Perl OR GPL-1.0-or-later", ["PERL-GRANT"]),
    ("psf-notice", "PSF-2.0", ["PSF-GRANT"]),
    ("unlicense-text", "Unlicense", ["UNLICENSE-FREE"]),
    ("cc0-waiver", "CC0-1.0", ["CC0-WAIVER"]),
    ("cc0-title", "CC0-1.0", ["CC0-TITLE"]),
    ("public-domain-notice", "LicenseRef-Public-Domain", ["PD-NOTICE"]),
    ("all-rights-reserved", "LicenseRef-All-Rights-Reserved", ["ALL-RIGHTS"]),
]
#: The licences of the GNU family, their versions, and what a header may call the work.
GNU = [
    ("GPL", "GNU General Public License", ["2", "3"]),
    ("LGPL", "GNU Lesser General Public License", ["2.1", "3"]),
    ("LGPL", "GNU Library General Public License", ["2"]),
    ("AGPL", "GNU Affero General Public License", ["3"]),
]
WORKS = ["program", "library", "software", "file"]
#: Creative Commons licences, with the words of their names, and versions with theirs.
COMMONS = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]
COMMONS_VERSIONS = [("4.0", "International"), ("3.0", "Unported")]
#: Identifiers that tags name.
TAGS = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "Zlib", "Unlicense", "CC0-1.0", "BSL-1.0", "MPL-2.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC-BY-4.0", "CC-BY-SA-4.0", "MIT OR Apache-2.0", "Apache-2.0 OR MIT", "GPL-2.0 WITH Linux-syscall-note"]


def _gnu() -> None:
    """Headers and notices of the GNU family, a sentence for each licence, version and name of the work."""
    for work in WORKS:
        SENTENCES.append(("GNU-WARRANTY", f"This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."))
    for short, name, versions in GNU:
        SENTENCES.append((f"{name}: COPY", f"See the {name} for more details."))
        for v in versions:
            full = f"{short}-{v}" if "." in v else f"{short}-{v}.0"
            key, rule = f"{name} {v}", f"{name.split()[1].lower()}-{full.lower()}" if name.split()[1] == "Library" else full.lower()
            for work in WORKS:
                begin = f"This {work} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation"
                SENTENCES.append((f"{key}: FREE-LATER", f"{begin}, either version {v} of the License, or (at your option) any later version."))
                SENTENCES.append((f"{key}: FREE-ONLY", f"{begin}; version {v} of the License."))
            SENTENCES.append((f"{key}: NOTICE", f"This work is licensed under the {name}, version {v}."))
            SENTENCES.append((f"{key}: NOTICE", f"Licensed under the {name}, version {v}."))
            for kind, suffix in (("LATER", "or-later"), ("ONLY", "only")):
                RULES.append((f"{rule}-{kind.lower()}-grant", f"{full}-{suffix}", [f"{key}: FREE-{kind}"]))
                RULES.append((f"{rule}-{kind.lower()}-header", f"{full}-{suffix}", [f"{key}: FREE-{kind}", "GNU-WARRANTY", f"{name}: COPY"]))
            RULES.append((f"{rule}-notice", full, [f"{key}: NOTICE"]))


def _commons() -> None:
    for short, name in COMMONS:
        for version, kind in COMMONS_VERSIONS:
            key, rule = f"CC-{short}-{version}", f"cc-{short.lower()}-{version}"
            SENTENCES.append((f"{key}-NOTICE", f"Licensed under CC {short} {version}."))
            SENTENCES.append((f"{key}-NOTICE", f"This work is licensed under a Creative Commons {name} {version} {kind} License."))
            SENTENCES.append((f"{key}-NOTICE", f"This work is licensed under the Creative Commons {name} {version} {kind} License."))
            RULES.append((f"{rule}-notice", key, [f"{key}-NOTICE"]))


def _tags() -> None:
    for tag in TAGS:
        SENTENCES.append((f"TAG-{tag}", f"SPDX-License-Identifier: {tag}"))
        RULES.append((f"tag-{tag.lower().replace(' ', '-')}", tag, [f"TAG-{tag}"]))


_gnu()
_commons()
_tags()
#: Words of which every rule has one in some sentence, whatever its wording; texts without any of them need no further look.
TRIGGERS = ["licen", "copyright", "permi", "redistribut", "rights", "warrant", "public domain", "endorse", "advertising"]
