"""Identifiers of the public SPDX list, exceptions, and phrases that stand for licenses, as data."""

from __future__ import annotations

IDENTIFIERS: frozenset[str] = frozenset(
    """
    0BSD AAL AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 AGPL-1.0 AGPL-1.0-only AGPL-1.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later APL-1.0 APSL-1.0 APSL-1.1 APSL-1.2 APSL-2.0
    Abstyles AdaCore-doc Adobe-2006 Adobe-Glyph Afmparse Aladdin Apache-1.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-1.0-Perl Artistic-1.0-cl8 Artistic-2.0 BSD-1-Clause BSD-2-Clause
    BSD-2-Clause-Patent BSD-2-Clause-Views BSD-3-Clause BSD-3-Clause-Attribution BSD-3-Clause-Clear BSD-3-Clause-LBNL BSD-3-Clause-Modification BSD-3-Clause-No-Nuclear-License BSD-3-Clause-Open-MPI
    BSD-4-Clause BSD-4-Clause-UC BSD-Protection BSD-Source-Code BSL-1.0 BUSL-1.1 Bahyph Barr Beerware BitTorrent-1.0 BitTorrent-1.1 BlueOak-1.0.0 Borceux CAL-1.0 CATOSL-1.1 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5
    CC-BY-3.0 CC-BY-4.0 CC-BY-NC-1.0 CC-BY-NC-2.0 CC-BY-NC-2.5 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-1.0 CC-BY-NC-ND-2.0 CC-BY-NC-ND-2.5 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-1.0
    CC-BY-NC-SA-2.0 CC-BY-NC-SA-2.5 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-1.0 CC-BY-ND-2.0 CC-BY-ND-2.5 CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-SA-1.0 CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0
    CC-PDDC CC0-1.0 CDDL-1.0 CDDL-1.1 CDLA-Permissive-1.0 CDLA-Permissive-2.0 CDLA-Sharing-1.0 CECILL-1.0 CECILL-1.1 CECILL-2.0 CECILL-2.1 CECILL-B CECILL-C CERN-OHL-1.1 CERN-OHL-1.2 CERN-OHL-P-2.0
    CERN-OHL-S-2.0 CERN-OHL-W-2.0 CNRI-Jython CNRI-Python CPAL-1.0 CPL-1.0 CPOL-1.02 CUA-OPL-1.0 ClArtistic Condor-1.1 Crossword CrystalStacker Cube D-FSL-1.0 DOC DRL-1.0 DSDP Dotseqn ECL-1.0 ECL-2.0
    EFL-1.0 EFL-2.0 EPICS EPL-1.0 EPL-2.0 EUDatagrid EUPL-1.0 EUPL-1.1 EUPL-1.2 Elastic-2.0 Entessa ErlPL-1.1 Eurosym FSFAP FSFUL FSFULLR FTL Fair Frameworx-1.0 FreeImage GFDL-1.1 GFDL-1.1-only
    GFDL-1.1-or-later GFDL-1.2 GFDL-1.2-only GFDL-1.2-or-later GFDL-1.3 GFDL-1.3-only GFDL-1.3-or-later GL2PS GPL-1.0 GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0
    GPL-3.0-only GPL-3.0-or-later Giftware Glide Glulxe HPND HaskellReport Hippocratic-2.1 IBM-pibs ICU IJG IPA IPL-1.0 ISC ImageMagick Imlib2 Info-ZIP Intel Intel-ACPI Interbase-1.0 JPNIC JSON
    JasPer-2.0 LAL-1.2 LAL-1.3 LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LGPLLR LPL-1.0 LPL-1.02 LPPL-1.0 LPPL-1.1
    LPPL-1.2 LPPL-1.3a LPPL-1.3c Latex2e Leptonica LiLiQ-P-1.1 LiLiQ-R-1.1 LiLiQ-Rplus-1.1 Libpng Linux-OpenIB MIT MIT-0 MIT-CMU MIT-Modern-Variant MIT-advertising MIT-enna MIT-feh MITNFA MPL-1.0 MPL-1.1
    MPL-2.0 MPL-2.0-no-copyleft-exception MS-PL MS-RL MTLL MakeIndex MirOS Motosoto MulanPSL-1.0 MulanPSL-2.0 Multics Mup NASA-1.3 NBPL-1.0 NCSA NGPL NLOD-1.0 NOSL NPL-1.0 NPL-1.1 NPOSL-3.0 NTP Naumen
    Net-SNMP NetCDF Newsletr Nokia Noweb Nunit OCCT-PL OCLC-2.0 ODC-By-1.0 ODbL-1.0 OFL-1.0 OFL-1.1 OGC-1.0 OGL-UK-1.0 OGL-UK-2.0 OGL-UK-3.0 OGTSL OLDAP-2.0 OLDAP-2.7 OLDAP-2.8 OML OPL-1.0 OSET-PL-2.1
    OSL-1.0 OSL-1.1 OSL-2.0 OSL-2.1 OSL-3.0 OpenSSL PDDL-1.0 PHP-3.0 PHP-3.01 PSF-2.0 Parity-7.0.0 Plexus PolyForm-Noncommercial-1.0.0 PolyForm-Small-Business-1.0.0 PostgreSQL Python-2.0 QPL-1.0 Qhull
    RHeCos-1.1 RPL-1.1 RPL-1.5 RPSL-1.0 RSA-MD RSCPL Rdisc Ruby SAX-PD SCEA SGI-B-1.0 SGI-B-1.1 SGI-B-2.0 SISSL SISSL-1.2 SMLNJ SMPPL SNIA SPL-1.0 SSH-OpenSSH SSPL-1.0 SWL Saxpath Sendmail SimPL-2.0
    Sleepycat Spencer-86 Spencer-94 Spencer-99 SugarCRM-1.1.3 TCL TCP-wrappers TMate TORQUE-1.1 TOSL UCL-1.0 UPL-1.0 Unicode-DFS-2015 Unicode-DFS-2016 Unicode-3.0 Unicode-TOU Unlicense VOSTROM VSL-1.0 Vim W3C
    W3C-19980720 W3C-20150513 WTFPL Watcom-1.0 Wsuipa X11 XFree86-1.1 XSkat Xerox Xnet YPL-1.0 YPL-1.1 ZPL-1.1 ZPL-2.0 ZPL-2.1 Zed Zend-2.0 Zimbra-1.3 Zimbra-1.4 Zlib bzip2-1.0.6 curl dvipdfm eGenix
    etalab-2.0 gSOAP-1.3b gnuplot iMatix libpng-2.0 libtiff mpich2 psutils xinetd xpp zlib-acknowledgement
    """.split()
)

EXCEPTIONS: frozenset[str] = frozenset(
    """
    389-exception Autoconf-exception-2.0 Autoconf-exception-3.0 Bison-exception-2.2 Bootloader-exception Classpath-exception-2.0 CLISP-exception-2.0 DigiRule-FOSS-exception eCos-exception-2.0 FLTK-exception
    Fawkes-Runtime-exception Font-exception-2.0 freertos-exception-2.0 GCC-exception-2.0 GCC-exception-3.1 gnu-javamail-exception GPL-3.0-linking-exception GPL-CC-1.0 i2p-gpl-java-exception
    LGPL-3.0-linking-exception Libtool-exception Linux-syscall-note LLVM-exception LZMA-exception mif-exception Nokia-Qt-exception-1.1 OCaml-LGPL-linking-exception OpenJDK-assembly-exception-1.0
    openvpn-openssl-exception PS-or-PDF-font-exception-20170817 Qt-GPL-exception-1.0 Qt-LGPL-exception-1.1 Qwt-exception-1.0 Swift-exception u-boot-exception-2.0 Universal-FOSS-exception-1.0 WxWindows-exception-3.1
    """.split()
)

_NAMES = """
Apache-2.0|licensed under the apache license, version 2.0|apache license, version 2.0|apache license version 2.0|apache license 2.0|apache software license, version 2.0|apache software license 2.0|apache-2.0 license|apache license
Apache-1.1|apache software license, version 1.1|apache software license 1.1|apache license 1.1
Apache-1.0|apache software license, version 1.0|apache license 1.0
MIT|released under the mit license|the mit license (mit)|mit license|permission is hereby granted, free of charge|expat license
MIT-0|mit no attribution|mit-0 license
BSD-2-Clause|bsd 2-clause license|2-clause bsd license|simplified bsd license|freebsd license|bsd two-clause license
BSD-3-Clause|bsd 3-clause license|3-clause bsd license|new bsd license|revised bsd license|modified bsd license|bsd three-clause license|redistribution and use in source and binary forms
BSD-4-Clause|bsd 4-clause license|4-clause bsd license|original bsd license
0BSD|zero-clause bsd|bsd zero clause license
ISC|isc license|permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
MPL-1.0|mozilla public license, version 1.0|mozilla public license version 1.0|mozilla public license 1.0
MPL-1.1|mozilla public license, version 1.1|mozilla public license version 1.1|mozilla public license 1.1|mozilla public license
MPL-2.0|mozilla public license, version 2.0|mozilla public license version 2.0|mozilla public license, v. 2.0|mozilla public license 2.0|mpl-2.0 license
EPL-1.0|eclipse public license, version 1.0|eclipse public license 1.0|eclipse public license - v 1.0|eclipse public license v1.0
EPL-2.0|eclipse public license, version 2.0|eclipse public license 2.0|eclipse public license - v 2.0|eclipse public license v2.0|eclipse public license
CDDL-1.0|common development and distribution license, version 1.0|common development and distribution license (cddl) version 1.0|common development and distribution license 1.0|common development and distribution license
CDDL-1.1|common development and distribution license, version 1.1|common development and distribution license 1.1
CPL-1.0|common public license, version 1.0|common public license version 1.0|common public license 1.0
EUPL-1.1|european union public licence, version 1.1|european union public licence v. 1.1|european union public license 1.1
EUPL-1.2|european union public licence, version 1.2|european union public licence v. 1.2|european union public license 1.2|european union public licence
BSL-1.0|boost software license, version 1.0|boost software license - version 1.0|boost software license 1.0|boost software license
BUSL-1.1|business source license 1.1|business source license
Elastic-2.0|elastic license 2.0|elastic license v2
SSPL-1.0|server side public license, version 1|server side public license
Unlicense|the unlicense|this is free and unencumbered software released into the public domain
WTFPL|do what the fuck you want to public license
Zlib|zlib license|zlib/libpng license
Libpng|libpng license
PostgreSQL|postgresql license
Python-2.0|python software foundation license version 2|psf license agreement
PHP-3.01|php license, version 3.01|php license version 3.01
PHP-3.0|php license, version 3.0|php license version 3.0
Ruby|ruby license
Artistic-1.0|artistic license 1.0|the artistic license
Artistic-2.0|artistic license 2.0|the artistic license 2.0
NCSA|university of illinois/ncsa open source license|ncsa open source license
OFL-1.1|sil open font license, version 1.1|sil open font license version 1.1|sil open font license 1.1|sil open font license
OFL-1.0|sil open font license, version 1.0|sil open font license 1.0
AFL-3.0|academic free license version 3.0|academic free license 3.0|academic free license
OSL-3.0|open software license version 3.0|open software license 3.0|open software license
MS-PL|microsoft public license
MS-RL|microsoft reciprocal license
UPL-1.0|universal permissive license, version 1.0|universal permissive license
QPL-1.0|q public license
LPPL-1.3c|latex project public license, version 1.3c|latex project public license 1.3c
LPPL-1.0|latex project public license
CECILL-2.1|cecill free software license agreement version 2.1|cecill 2.1
CECILL-B|cecill-b free software license
CECILL-C|cecill-c free software license
OpenSSL|openssl license
Vim|vim license
W3C|w3c software notice and license
X11|x11 license
JSON|the software shall be used for good, not evil
Beerware|the beer-ware license|beerware license
ODbL-1.0|open database license 1.0|open data commons open database license|open database license
ODC-By-1.0|open data commons attribution license
PDDL-1.0|open data commons public domain dedication
CDLA-Permissive-2.0|community data license agreement - permissive - version 2.0
CDLA-Permissive-1.0|community data license agreement - permissive - version 1.0
CDLA-Sharing-1.0|community data license agreement - sharing - version 1.0
CC0-1.0|cc0 1.0 universal|cc0 1.0|creative commons zero v1.0 universal|creative commons zero|creative commons cc0
GFDL-1.1-or-later|gnu free documentation license, version 1.1 or any later version
GFDL-1.2-or-later|gnu free documentation license, version 1.2 or any later version
GFDL-1.3-or-later|gnu free documentation license, version 1.3 or any later version
GFDL-1.1-only|gnu free documentation license, version 1.1
GFDL-1.2-only|gnu free documentation license, version 1.2
GFDL-1.3-only|gnu free documentation license, version 1.3
GPL-1.0-or-later|gnu general public license|gnu gpl
LGPL-2.0-or-later|gnu lesser general public license|gnu library general public license|gnu lgpl
AGPL-3.0-only|gnu affero general public license|gnu agpl
LicenseRef-Proprietary|all rights reserved
"""

_GNU = (
    ("GPL", "gnu general public license", ("1", "2", "3")),
    ("LGPL", "gnu lesser general public license", ("2.1", "3")),
    ("LGPL", "gnu library general public license", ("2",)),
    ("AGPL", "gnu affero general public license", ("1", "3")),
)
_LATER = (
    "{name} as published by the free software foundation, either version {v} of the license, or (at your option) any later version",
    "{name} as published by the free software foundation; either version {v} of the license, or (at your option) any later version",
    "{name} as published by the free software foundation; either version {v}, or (at your option) any later version",
    "{name}, version {v} or (at your option) any later version",
    "{name}, version {v}, or (at your option) any later version",
    "{name} version {v} or (at your option) any later version",
    "{name}, version {v} or any later version",
    "{name} version {v} or any later version",
    "{name}, version {v} or later",
    "{name} version {v} or later",
    "{name} v{v} or later",
    "{name} v{v}+",
    "{short} version {v} or later",
    "{short} v{v} or later",
    "{short}v{v} or later",
    "{short}v{v}+",
    "{short}-{v}+",
)
_ONLY = (
    "{name} as published by the free software foundation, version {v}",
    "{name} as published by the free software foundation; version {v}",
    "{name}, version {v}",
    "{name} version {v}",
    "{name} v{v}",
    "{short} version {v}",
    "{short} v{v}",
    "{short}v{v}",
)
_CC = (("by", "attribution"), ("by-sa", "attribution-sharealike"), ("by-nd", "attribution-noderivatives"), ("by-nc", "attribution-noncommercial"), ("by-nc-sa", "attribution-noncommercial-sharealike"), ("by-nc-nd", "attribution-noncommercial-noderivatives"))
_CC_FORMS = ("cc {short} {v}", "cc-{short}-{v}", "creative commons {name} {v}", "creative commons {name} {v} international", "creative commons {name} license {v}")


def _phrases() -> dict[str, str]:
    out: dict[str, str] = {}
    for line in _NAMES.strip().splitlines():
        license_id, *phrases = line.split("|")
        out |= dict.fromkeys(phrases, license_id)
    for short, name, versions in _GNU:
        for v in versions:
            known = f"{short}-{v if '.' in v else v + '.0'}"
            for forms, tail in ((_LATER, "-or-later"), (_ONLY, "-only")):
                for form in forms:
                    for said in {v, v if "." in v else f"{v}.0"}:
                        out.setdefault(form.format(name=name, short=short.lower(), v=said), known + tail)
    for short, name in _CC:
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            for form in _CC_FORMS:
                out[form.format(short=short, name=name, v=v)] = f"CC-{short.upper()}-{v}"
        out[f"creative commons {name}"] = f"CC-{short.upper()}-4.0"
    return out


NOTICES: tuple[tuple[str, str], ...] = tuple(_phrases().items())
"""(phrase in lower case with single blanks, license) of some hundred phrases."""

_KNOWN = {x.lower() for x in IDENTIFIERS}
_KNOWN_EXCEPTIONS = {x.lower() for x in EXCEPTIONS}


def is_known(identifier: str) -> bool:
    """Whether a license identifier is on the list, in any case, with `+` or not, or is a reference of somebody's own."""
    low = identifier.lower()
    return low.removesuffix("+") in _KNOWN or low.startswith(("licenseref-", "documentref-"))


def is_known_exception(identifier: str) -> bool:
    return identifier.lower() in _KNOWN_EXCEPTIONS
