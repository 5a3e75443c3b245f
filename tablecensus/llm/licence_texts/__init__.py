"""Longer texts of licences: headers of source files, titles and whole licence files."""

from importlib.resources import files

# Licences whose whole text is in this folder.
WHOLE = (
    "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1",
    "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0", "Unlicense", "Zlib",
)
# Words of "SPDX-License-Identifier:" tags, by the name that is given for them.
SPDX = {
    name: (name,)
    for name in (
        "0BSD", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC-BY-3.0", "CC-BY-4.0",
        "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "ISC",
        "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "NCSA", "OFL-1.1", "PSF-2.0", "Unicode-DFS-2016", "Unlicense", "WTFPL", "Zlib",
    )
} | {
    f"{name}-{version}": (f"{name}-{version}", f"{name}-{version}-only", f"{name}-{version}-or-later")
    for name, version in (("GPL", "1.0"), ("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0"))
}

_GNU = """This {work} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License
as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."""
_GNU_ONLY = """This {work} is free software; you can redistribute it and/or modify it under the terms of version {version} of the GNU {kind}General Public License
as published by the Free Software Foundation."""
_GNU_REST = """This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details.

You should have received a copy of the GNU {kind}General Public License along with this {work}{address}"""
_WEB = ". If not, see <https://www.gnu.org/licenses/>."
_POST = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"


def _gnu(kind: str, version: str) -> list[str]:
    """A GNU header whole and its first paragraph, in the wordings in use."""
    found = []
    for work in ("program", "library") if kind == "Lesser " else ("program",):
        for start in (_GNU, _GNU_ONLY):
            for rest in ("", f"\n\n{_GNU_REST}"):
                for address in (_WEB, _POST) if rest else ("",):
                    found.append((start + rest).format(work=work, kind=kind, version=version, address=address))
    return found


_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License."""
_ASF = """Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with
this work for additional information regarding copyright ownership. The ASF licenses this file to you under the Apache License, Version 2.0
(the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License."""
_CC = """By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this
Creative Commons {kind} 4.0 International Public License ("Public License"). To the extent this Public License may be interpreted as a contract,
You are granted the Licensed Rights in consideration of Your acceptance of these terms and conditions, and the Licensor grants You such rights
in consideration of benefits the Licensor receives from making the Licensed Material available under these terms and conditions."""
_CC_NOTICE = "This work is licensed under a Creative Commons {kind} 4.0 International License."

HEADERS = {
    "Apache-2.0": [_APACHE, _ASF, "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/"],
    "GPL-1.0": ["GNU GENERAL PUBLIC LICENSE\nVersion 1, February 1989", *_gnu("", "1")],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", *_gnu("", "2")],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", *_gnu("", "3")],
    "LGPL-2.0": ["GNU LIBRARY GENERAL PUBLIC LICENSE\nVersion 2, June 1991", *_gnu("Library ", "2")],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999", *_gnu("Lesser ", "2.1")],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", *_gnu("Lesser ", "3")],
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007", *_gnu("Affero ", "3")],
    "MPL-2.0": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        "Mozilla Public License Version 2.0",
    ],
    "MIT": ["The MIT License (MIT)"],
    "CC-BY-4.0": [t.format(kind="Attribution") for t in (_CC, _CC_NOTICE)],
    "CC-BY-SA-4.0": [t.format(kind="Attribution-ShareAlike") for t in (_CC, _CC_NOTICE)],
    "CC-BY-NC-4.0": [t.format(kind="Attribution-NonCommercial") for t in (_CC, _CC_NOTICE)],
}

_REMOTE = """  13. Remote Network Interaction; Use with the GNU General Public License.

  Notwithstanding any other provision of this License, if you modify the
Program, your modified version must prominently offer all users
interacting with it remotely through a computer network (if your version
supports such interaction) an opportunity to receive the Corresponding
Source of your version by providing access to the Corresponding Source
from a network server at no charge, through some standard or customary
means of facilitating copying of software.  This Corresponding Source
shall include the Corresponding Source for any work covered by version 3
of the GNU General Public License that is incorporated pursuant to the
following paragraph.

  Notwithstanding any other provision of this License, you have permission
to link or combine any covered work with a work licensed under version 3
of the GNU General Public License into a single combined work, and to
convey the resulting work.  The terms of this License will continue to
apply to the part which is the covered work, but the work with which it is
combined will remain governed by version 3 of the GNU General Public
License.

"""


def whole(name: str) -> str:
    return files(__name__).joinpath(f"{name}.txt").read_text(encoding="utf-8")


def _affero() -> str:
    """The AGPL from the GPL: title, name and the section on networks; without the preamble, which is its own."""
    gpl = whole("GPL-3.0")
    start, remote, after = gpl.index("TERMS AND CONDITIONS"), gpl.index("  13. Use with"), gpl.index("  14. Revised Versions")
    renamed = [t.replace("GNU G", "GNU Affero G").replace("GNU GENERAL", "GNU AFFERO GENERAL") for t in (gpl[start:remote], gpl[after:])]
    return "\n".join([HEADERS["AGPL-3.0"][0], renamed[0], _REMOTE, renamed[1]])


def texts() -> dict[str, list[str]]:
    """All of them by licence: headers, titles, whole files, and the conditions of BSD without what follows."""
    found = {name: list(headers) for name, headers in HEADERS.items()}
    for name in WHOLE:
        found.setdefault(name, []).append(whole(name))
    found["AGPL-3.0"].append(_affero())
    for name in ("BSD-2-Clause", "BSD-3-Clause"):
        text = found[name][0]
        found[name].append(text[text.index("Redistribution") : text.index("THIS SOFTWARE")])
    return found
