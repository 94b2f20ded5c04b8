"""Templates of common licences: notices that stand in other files, and texts that only a licence file has (whole, or how a long one begins)."""

from __future__ import annotations

_FSF = "under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
_FSF_ONLY = "This work is licensed under the GNU {name}, version {version}."
_CC = "This work is licensed under a Creative Commons {long} {version} International License."

#: Notices and headers, as their owners ask for them.
NOTICES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ),
    "MIT": ("Released under the MIT License.", "This project is licensed under the terms of the MIT license."),
    "GPL-2.0": (_FSF_ONLY.format(name="General Public License", version="2"), _FSF.format(name="General Public License", version="2")),
    "GPL-3.0": (_FSF_ONLY.format(name="General Public License", version="3"), _FSF.format(name="General Public License", version="3")),
    "LGPL-2.1": (_FSF_ONLY.format(name="Lesser General Public License", version="2.1"), _FSF.format(name="Lesser General Public License", version="2.1")),
    "LGPL-3.0": (_FSF_ONLY.format(name="Lesser General Public License", version="3"), _FSF.format(name="Lesser General Public License", version="3")),
    "AGPL-3.0": (_FSF_ONLY.format(name="Affero General Public License", version="3"), _FSF.format(name="Affero General Public License", version="3")),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", _CC.format(long="Attribution", version="4.0")),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", _CC.format(long="Attribution-ShareAlike", version="4.0")),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", _CC.format(long="Attribution-NonCommercial", version="4.0")),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.",),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.",),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.",),
    "ISC": ("Released under the ISC License.",),
    "Unlicense": ("Released into the public domain under the Unlicense.",),
}
NOTICES = {name: (*notices, f"SPDX-License-Identifier: {name}") for name, notices in NOTICES.items()}

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{third}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = "GNU {title} Version {version} Copyright (C) {years} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. "
_CC_CODE = """{long} {version} International
By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons {long} {version} International Public License ("Public License"). To the extent this Public License may be interpreted as a contract, You are granted the Licensed Rights in consideration of Your acceptance of these terms and conditions, and the Licensor grants You such rights in consideration of benefits the Licensor receives from making the Licensed Material available under these terms and conditions."""

#: Texts of licence files.
TEXTS: dict[str, tuple[str, ...]] = {
    "MIT": (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    "BSD-2-Clause": (_BSD.format(third=""),),
    "BSD-3-Clause": (_BSD.format(third="3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"),),
    "ISC": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    "Unlicense": (
        """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.""",
    ),
    "Apache-2.0": (
        """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/
TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.""",
    ),
    "GPL-2.0": (_GNU.format(title="GENERAL PUBLIC LICENSE", version="2, June 1991", years="1989, 1991") + "Preamble The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software",),
    "GPL-3.0": (_GNU.format(title="GENERAL PUBLIC LICENSE", version="3, 29 June 2007", years="2007") + "Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works.",),
    "LGPL-2.1": (_GNU.format(title="LESSER GENERAL PUBLIC LICENSE", version="2.1, February 1999", years="1991, 1999") + "This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1.",),
    "LGPL-3.0": (_GNU.format(title="LESSER GENERAL PUBLIC LICENSE", version="3, 29 June 2007", years="2007") + "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",),
    "AGPL-3.0": (_GNU.format(title="AFFERO GENERAL PUBLIC LICENSE", version="3, 19 November 2007", years="2007") + "Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",),
    "MPL-2.0": ("""Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. 1.2. "Contributor Version" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor's Contribution.""",),
    "CC-BY-4.0": (_CC_CODE.format(long="Attribution", version="4.0"),),
    "CC-BY-SA-4.0": (_CC_CODE.format(long="Attribution-ShareAlike", version="4.0"),),
    "CC-BY-NC-4.0": (_CC_CODE.format(long="Attribution-NonCommercial", version="4.0"),),
    "CC0-1.0": ("""Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP. CREATIVE COMMONS PROVIDES THIS INFORMATION ON AN "AS-IS" BASIS.""",),
}
