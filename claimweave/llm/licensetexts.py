"""Signatures of license texts, headers, notices and statements, written out by hand.

Each is a label, a pattern over normalised words (lower-cased, one space
between, no punctuation) and a keyword that every match contains.  A text that
quotes one need not name its license.
"""

#: Sentences of licence bodies and headers.
BODIES = (
    ("mit-0", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided", "sublicense"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial"),
    ("mit", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies", "sublicense"),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise", "tort"),
    ("x11", r"shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization", "dealings"),
    ("0bsd", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", "granted"),
    ("isc", r"provided that the above copyright notice and this permission notice appear in all copies", "appear"),
    ("isc", r"the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "disclaims"),
    ("bsd", r"redistributions of source code must retain the above copyright notice", "redistributions"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", "redistributions"),
    ("bsd", r"this software is provided by the (?:\w+ ){1,8}?as is and any express or implied warranties including but not limited to the implied warranties of merchantability", "merchantability"),
    ("bsd-3-clause", r"neither the names? of (?:\w+ ){1,12}?may be used to endorse or promote products derived from this software", "endorse"),
    ("bsd-3-clause-clear", r"no express or implied licenses to any party s patent rights are granted by this license", "patent"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "advertising"),
    ("bsd-2-clause-patent", r"a perpetual worldwide non exclusive no charge royalty free irrevocable except for failure to satisfy the conditions of this license patent license", "irrevocable"),
    ("bsd-3-clause-no-nuclear", r"is not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility", "nuclear"),
    ("bsd-source-code", r"redistributions of source code must retain the above copyright notice this condition and the following disclaimer", "redistributions"),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "agreement"),
    ("ntp", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted provided that the above copyright notice appears in all copies", "appears"),
    ("hpnd", r"permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee", "documentation"),
    ("hpnd", r"makes no representations about the suitability of this software for any purpose it is provided as is without express or implied warranty", "suitability"),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "damages"),
    ("zlib", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", "misrepresented"),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "misrepresented"),
    ("libpng", r"the contributing authors and group 42 inc disclaim all warranties expressed or implied", "disclaim"),
    ("libpng", r"this copyright notice may not be removed or altered from any source or altered source distribution", "altered"),
    ("ijg", r"this software is based in part on the work of the independent jpeg group", "jpeg"),
    ("libtiff", r"the names of sam leffler and silicon graphics may not be used in any advertising or publicity relating to the software", "publicity"),
    ("freetype", r"portions of this software are copyright c? ?(?:\w+ )?the freetype project", "freetype"),
    ("boost", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "accompanying"),
    ("boost", r"unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor", "processor"),
    ("apache-2", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce", "irrevocable"),
    ("apache-2", r"software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", "warranties"),
    ("apache-2", r"you may not use this file except in compliance with the license", "compliance"),
    ("apache-2", r"you must give any other recipients of the work or derivative works a copy of this license", "recipients"),
    ("apache-2", r"you must cause any modified files to carry prominent notices stating that you changed the files", "prominent"),
    ("apache-2", r"if the work includes a notice text file as part of its distribution then any derivative works that you distribute must include a readable copy", "readable"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", "apache"),
    ("apache-1.1", r"the names apache and apache software foundation must not be used to endorse or promote products derived from this software", "endorse"),
    ("apache-1", r"this product includes software developed by the apache group for use in the apache http server project", "apache"),
    ("gpl", r"you may copy and distribute verbatim copies of the program s source code as you receive it in any medium", "verbatim"),
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute"),
    ("gpl", r"this program is distributed in the hope that it will be useful but without any warranty", "hope"),
    ("gpl", r"you should have received a copy of the gnu general public license along with", "gnu"),
    ("gpl", r"either version [23] of the license or at your option any later version", "option"),
    ("gpl-1", r"either version 1 or at your option any later version", "option"),
    ("gpl-2", r"if you distribute copies of such a program whether gratis or for a fee you must give the recipients all the rights that you have", "gratis"),
    ("gpl-2", r"you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program or any part thereof to be licensed as a whole at no charge to all third parties", "thereof"),
    ("gpl-2", r"you may not copy modify sublicense or distribute the program except as expressly provided under this license", "sublicense"),
    ("gpl-2", r"the licenses for most software are designed to take away your freedom to share and change it", "freedom"),
    ("gpl-3", r"if you distribute copies of such a program whether gratis or for a fee you must pass on to the recipients the same freedoms that you received", "gratis"),
    ("gpl-3", r"the gnu general public license is a free copyleft license for software and other kinds of works", "copyleft"),
    ("gpl-3", r"you may convey verbatim copies of the program s source code as you receive it in any medium", "convey"),
    ("gpl-3", r"you may not propagate or modify a covered work except as expressly provided under this license", "propagate"),
    ("gpl-classpath", r"linking this library statically or dynamically with other modules is making a combined work based on this library", "linking"),
    ("gpl-classpath", r"gives? you permission to link this library with independent modules to produce an executable", "independent"),
    ("gpl-gcc", r"you have permission to propagate a work of target code formed by combining the runtime library with independent modules", "runtime"),
    ("gpl-autoconf", r"as a special exception to the gnu general public license if you distribute this file as part of a program that contains a configuration script generated by autoconf", "autoconf"),
    ("gpl-bison", r"you may create a larger work that contains part or all of the bison parser skeleton", "bison"),
    ("gpl-openssl", r"permission to link the code of portions of this program with the openssl library", "openssl"),
    ("gpl-linux", r"this copyright does not cover user programs that use kernel services by normal system calls", "kernel"),
    ("lgpl", r"you should have received a copy of the gnu lesser general public license along with", "lesser"),
    ("lgpl-2.1", r"a program that contains no derivative of any portion of the library but is designed to work with the library by being compiled or linked with it", "derivative"),
    ("lgpl-2.1", r"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lesser"),
    ("lgpl-2", r"this library is free software you can redistribute it and or modify it under the terms of the gnu library general public license", "library"),
    ("lgpl-3", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license", "incorporates"),
    ("lgpl-3", r"a combined work is a work produced by combining or linking an application with the library", "combining"),
    ("agpl-3", r"your modified version must prominently offer all users interacting with it remotely through a computer network", "remotely"),
    ("agpl-3", r"it requires the operator of a network server to provide the source code of the modified version running there to the users of that server", "operator"),
    ("agpl-3", r"you should have received a copy of the gnu affero general public license along with", "affero"),
    ("fdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "documentation"),
    ("fdl", r"with no invariant sections no front cover texts and no back cover texts", "invariant"),
    ("fdl", r"the purpose of this license is to make a manual textbook or other functional and useful document free in the sense of freedom", "textbook"),
    ("gnu-all-permissive", r"copying and distribution of this file with or without modification are permitted in any medium without royalty", "royalty"),
    ("fsf-unlimited", r"this file is free software the free software foundation gives unlimited permission to copy and or distribute it", "unlimited"),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
    ("mpl-2", r"covered software is provided under this license on an as is basis without warranty of any kind either expressed implied or statutory", "covered"),
    ("mpl-2", r"this source code form is incompatible with secondary licenses as defined by the mozilla public license", "incompatible"),
    ("mpl-2", r"all distribution of covered software in source code form including any modifications that you create or to which you contribute must be under the terms of this license", "covered"),
    ("mpl-1.1", r"software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language governing rights and limitations under the license", "governing"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1", "mozilla"),
    ("mpl-1.1", r"the initial developer of the original code is", "developer"),
    ("mpl-1", r"the contents of this file are subject to the mozilla public license version 1 0", "mozilla"),
    ("npl", r"the contents of this file are subject to the netscape public license", "netscape"),
    ("nokia", r"the contents of this file are subject to the nokia open source license", "nokia"),
    ("spl", r"the contents of this file are subject to the sun public license", "sun"),
    ("sissl", r"the contents of this file are subject to the sun industry standards source license", "sissl industry"),
    ("apsl", r"this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license", "apple"),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license", "development"),
    ("cddl", r"see the license for the specific language governing permissions and limitations under the license when distributing covered code", "governing"),
    ("cpal", r"the contents of this file are subject to the common public attribution license", "attribution"),
    ("cpl", r"this program and the accompanying materials are made available under the terms of the common public license", "common"),
    ("ipl", r"the accompanying program is provided under the terms of this ibm public license", "ibm"),
    ("epl-1", r"this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1 0", "eclipse"),
    ("epl-2", r"this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse"),
    ("epl-2", r"this source code may also be made available under the following secondary licenses when the conditions for such availability", "secondary"),
    ("edl", r"made available under the terms of the eclipse distribution license", "eclipse"),
    ("eupl", r"licensed under the eupl (?:version |v ?)?1 [012] or as soon they will be approved by the european commission subsequent versions", "eupl"),
    ("eupl", r"the licensor grants you a worldwide royalty free non exclusive sublicensable licence to do the following for the duration of copyright vested in the original work", "vested"),
    ("cecill", r"this software is governed by the cecill(?: [bc])? licen[cs]e under french law and abiding by the rules of distribution of free software", "cecill"),
    ("cecill", r"the fact that you are presently reading this means that you have had knowledge of the cecill", "cecill"),
    ("osl-3", r"licensed under the open software license version 3 0", "licensed"),
    ("afl-3", r"licensed under the academic free license version 3 0", "academic"),
    ("osl-3", r"you must distribute or communicate the source code of any derivative works that you externally deploy", "externally"),
    ("qpl", r"you may distribute your modifications in a form that is separate from the software such as patches", "patches"),
    ("qpl", r"this file may be distributed under the terms of the q public license", "q"),
    ("sleepycat", r"redistributions in any form must be accompanied by information on how to obtain complete source code for the db software", "accompanied"),
    ("artistic", r"you may make and give away verbatim copies of the source form of the standard version of this package without restriction", "verbatim"),
    ("artistic", r"you may charge a reasonable copying fee for any distribution of this package", "copying"),
    ("artistic-2", r"you are permitted to use the standard version and create and use modified versions for any purpose without restriction", "permitted"),
    ("artistic-2", r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed", "establishes"),
    ("perl", r"this (?:program|library|module) is free software you can redistribute it and or modify it under the same terms as perl itself", "perl"),
    ("ruby", r"you may make and give away verbatim copies of the source form of the software without restriction provided that you duplicate all of the original copyright notices", "duplicate"),
    ("ruby", r"you may distribute the software in object code or binary form provided that you do at least one of the following distribute the binaries and library files of the software", "binaries"),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", "verbatim"),
    ("wtfpl", r"0 you just do what the f\w+ you want to", "want"),
    ("beerware", r"as long as you retain this notice you can do whatever you want with this stuff if we meet some day and you think this stuff is worth it you can buy me a beer", "beer"),
    ("glwtpl", r"everyone is permitted to copy distribute modify merge sell publish sublicense or whatever they want with this software but at their own risk", "whatever"),
    ("json", r"the software shall be used for good not evil", "evil"),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", "compile"),
    ("unlicense", r"in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain", "jurisdictions"),
    ("sqlite-blessing", r"the author disclaims copyright to this source code in place of a legal notice here is a blessing", "blessing"),
    ("bzip2", r"if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required", "appreciated"),
    ("curl", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "appear"),
    ("curl", r"except as contained in this notice the name of a copyright holder shall not be used in advertising or otherwise to promote the sale use or other dealings in this software", "dealings"),
    ("icu", r"provided that the above copyright notice s and this permission notice appear in all copies of the software and that both the above copyright notice s and this permission notice appear in supporting documentation", "supporting"),
    ("unicode", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", "unicode"),
    ("unicode", r"without restriction including without limitation the rights to use copy modify merge publish distribute and or sell copies of the data files or software", "merge"),
    ("tcl", r"the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose", "authors"),
    ("tcl", r"government use if you are acquiring this software on behalf of the u s government the government shall have only restricted rights", "acquiring"),
    ("vim", r"there are no restrictions on distributing unmodified copies of vim", "vim"),
    ("xfree86", r"this product includes software developed by the xfree86 project", "xfree86"),
    ("w3c", r"permission to copy modify and distribute this (?:software and its documentation|work) with or without modification for any purpose and without fee or royalty is hereby granted", "royalty"),
    ("w3c", r"the full text of this notice in a location viewable to users of the redistributed or derivative work", "viewable"),
    ("ogc", r"permission is hereby granted by the open geospatial consortium", "geospatial"),
    ("ncsa", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers", "disclaimers"),
    ("ncsa", r"university of illinois ncsa open source license", "ncsa"),
    ("llvm-exception", r"as an exception if as a result of your compiling your source code portions of this software are embedded into an object form", "embedded"),
    ("afmparse", r"this file may be freely copied and redistributed as long as this entire notice continues to be included", "freely"),
    ("sil-ofl", r"neither the font software nor any of its individual components in original or modified versions may be sold by itself", "font"),
    ("sil-ofl", r"the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects", "font"),
    ("sil-ofl", r"no modified version of the font software may use the reserved font name s unless explicit written permission is granted", "reserved"),
    ("bitstream-vera", r"the fonts may be modified altered or added to and in particular the designs of glyphs or characters in the fonts may be modified", "glyphs"),
    ("ubuntu-font", r"this licence allows the licensed fonts to be used studied modified and redistributed freely", "fonts"),
    ("lppl", r"this work may be distributed and or modified under the conditions of the latex project public license", "latex"),
    ("lppl", r"the current maintainer of this work is", "maintainer"),
    ("openssl", r"this product includes software developed by the openssl project", "openssl"),
    ("openssl", r"the names openssl toolkit and openssl project must not be used to endorse or promote products", "openssl"),
    ("ssleay", r"this product includes cryptographic software written by eric young", "cryptographic"),
    ("php", r"this product includes php software freely available from", "php"),
    ("php", r"the name php must not be used to endorse or promote products derived from this software", "php"),
    ("zend", r"this product includes the zend engine freely available at", "zend"),
    ("python", r"psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform", "psf"),
    ("python", r"beopen hereby grants licensee a non exclusive royalty free world wide license", "beopen"),
    ("python", r"cnri hereby grants licensee a nonexclusive royalty free world wide license", "cnri"),
    ("zpl", r"names of the copyright holders must not be used to endorse or promote products derived from this software without prior written permission from the copyright holders", "holders"),
    ("zpl", r"subject to the provisions of the zope public license", "zope"),
    ("ms-pl", r"if you bring a patent claim against any contributor over patents that you claim are infringed by the software", "infringed"),
    ("ms-pl", r"if you distribute any portion of the software in source code form you may do so only under this license by including a complete copy of this license with your distribution", "portion"),
    ("ms-rl", r"for any file you distribute that contains code from the software in source code or binary format you must provide recipients the source code to that file", "binary"),
    ("upl", r"subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data", "associated"),
    ("ecl-2", r"licensed under the educational community license version 2 0", "educational"),
    ("rpl", r"unless explicitly acquired and licensed from licensor under another license the contents of this file are subject to the reciprocal public license", "reciprocal"),
    ("watcom", r"subject to the sybase open watcom public license", "watcom"),
    ("eudatagrid", r"this software includes voluntary contributions made to the eu datagrid", "datagrid"),
    ("mulan", r"you can use this software according to the terms and conditions of the mulan psl", "mulan"),
    ("blueoak", r"each contributor licenses you to do everything with this software that would otherwise infringe", "infringe"),
    ("parity", r"contribute software you develop operate or analyze with this software", "contribute"),
    ("polyform-noncommercial", r"any noncommercial purpose is a permitted purpose", "noncommercial"),
    ("polyform-shield", r"any purpose is a permitted purpose except for providing any product that competes with the software", "competes"),
    ("polyform-small", r"use of the software for the benefit of your company is use for a permitted purpose if your company has fewer than 100 total individuals", "fewer"),
    ("hippocratic", r"the software shall not be used by any person or entity for any systems activities or other uses that violate any human rights laws", "violate"),
    ("anti-996", r"the individual or the legal entity must strictly comply with all applicable laws regulations rules and standards of the jurisdiction relating to labor and employment", "labor"),
    ("commons-clause", r"the grant of rights under the license will not include and the license does not grant to you the right to sell the software", "sell"),
    ("elastic-2", r"you may not provide the software to third parties as a hosted or managed service", "hosted"),
    ("elastic-2", r"you may not move change disable or circumvent the license key functionality in the software", "circumvent"),
    ("sspl", r"if you make the functionality of the program or a modified version available to third parties as a service", "functionality"),
    ("busl", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", "licensor"),
    ("busl", r"effective on the change date or the fourth anniversary of the first publicly available distribution", "anniversary"),
    ("confluent", r"excluded purpose means making available any software as a service platform as a service infrastructure as a service", "excluded"),
    ("rsal", r"you may not make the functionality of the software or a modified version available to third parties as a service or distribute the software or a modified version in a manner that makes the functionality", "functionality"),
    ("timescale", r"licensed under the timescale license see license timescale for details", "timescale"),
    ("fsl", r"a competing use means making the software available to others in a commercial product or service", "competing"),
    ("cc0", r"the person who associated a work with this deed has dedicated the work to the public domain", "deed"),
    ("cc0", r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders", "affirmer"),
    ("cc0", r"to the extent possible under law (?:\w+ ){1,8}?has waived all copyright and related or neighboring rights", "waived"),
    ("cc", r"creative commons corporation is not a law firm and does not provide legal services", "corporation"),
    ("cc", r"by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons", "exercising"),
    ("cc", r"the work as defined below is provided under the terms of this creative commons public license", "commons"),
    ("cc-by", r"you must give appropriate credit provide a link to the license and indicate if changes were made", "credit"),
    ("cc-by-sa", r"if you remix transform or build upon the material you must distribute your contributions under the same license as the original", "remix"),
    ("cc-by-nd", r"if you remix transform or build upon the material you may not distribute the modified material", "remix"),
    ("cc-by-nc", r"you may not use the material for commercial purposes", "commercial"),
    ("odbl", r"you must keep intact any copyright or database right notices and notices that refer to this license", "intact"),
    ("odbl", r"this (?:\w+ ){1,4}?is made available under the open database license", "database"),
    ("odc-by", r"made available under the open data commons attribution license", "commons"),
    ("pddl", r"made available under the public domain dedication and license", "dedication"),
    ("ogl-uk", r"contains public sector information licensed under the open government licence", "government"),
    ("etalab", r"licence ouverte(?: v?\w+ \w+)? open licence", "ouverte"),
    ("dl-de", r"datenlizenz deutschland (?:namensnennung|zero)(?: version)?(?: 2 0)?", "datenlizenz"),
    ("cdla", r"community data license agreement (?:permissive|sharing)(?: version)?(?: [12] 0)?", "community"),
    ("openrail", r"you agree not to use the model or derivatives of the model in any way that violates any applicable national federal state local or international law", "derivatives"),
    ("openrail", r"use based restrictions as referenced in paragraph 5 must be included as an enforceable provision", "enforceable"),
    ("llama", r"is licensed under the llama (?:\d+ )*community license copyright c meta platforms", "llama"),
    ("gemma", r"gemma is provided under and subject to the gemma terms of use", "gemma"),
    ("gpl-de", r"dieses programm ist freie software sie können es unter den bedingungen der gnu general public license", "programm"),
    ("gpl-fr", r"ce programme est un logiciel libre vous pouvez le redistribuer et ou le modifier", "logiciel"),
    ("gpl-es", r"este programa es software libre(?: usted)? puede redistribuirlo y o modificarlo", "programa"),
)

#: Statements that a text is kept from use, or of whom it belongs to.
NOTICES = (
    ("proprietary", 4, 0.8, r"this (?:software|document|file|program) (?:is the|contains) (?:\w+ )?confidential and proprietary", "proprietary"),
    ("proprietary", 4, 0.8, r"unauthorized (?:copying|reproduction|distribution|use) of this (?:\w+ ){1,4}?(?:is )?(?:strictly )?prohibited", "unauthorized"),
    ("proprietary", 4, 0.8, r"no part of this (?:publication|book|document|work) may be reproduced (?:stored|distributed|transmitted)", "reproduced"),
    ("proprietary", 4, 0.8, r"without (?:the )?(?:express|prior) (?:written )?(?:permission|consent) of the (?:publisher|author|copyright (?:owner|holder))", "permission consent"),
    ("proprietary", 4, 0.7, r"for personal (?:and )?non commercial use only", "personal"),
    ("proprietary", 4, 0.7, r"internal use only", "internal"),
    ("proprietary", 4, 0.7, r"not for (?:public )?(?:release|resale)", "release resale"),
    ("proprietary", 4, 0.8, r"by (?:installing|downloading|using) (?:the|this) software you agree to be bound by (?:the terms of )?this (?:end user license )?agreement", "bound"),
    ("proprietary", 4, 0.8, r"you may not reverse engineer decompile or disassemble", "decompile"),
    ("proprietary", 4, 0.8, r"trade secrets? (?:and confidential information )?of", "trade"),
    ("proprietary", 4, 0.7, r"evaluation (?:copy|version|license) only", "evaluation"),
    ("public-domain", 4, 0.8, r"(?:this|the) (?:work|file|code|text|book|image) is in the public domain", "domain"),
    ("public-domain", 4, 0.8, r"(?:placed|released|dedicated) (?:in|into|to) the public domain", "domain"),
    ("public-domain", 4, 0.8, r"no copyright is claimed in the united states under title 17", "title"),
    ("gutenberg", 3, 0.9, r"this ebook is for the use of anyone anywhere (?:in the united states and most other parts of the world )?at no cost and with almost no restrictions whatsoever", "ebook"),
    ("gutenberg", 3, 0.9, r"under the terms of the project gutenberg license", "gutenberg"),
    ("copyright", 6, 0.5, r"this (?:article|material|content|work|book|page) is (?:protected by copyright|copyrighted)", "copyright copyrighted"),
    ("copyright", 6, 0.4, r"the copyright (?:holder|owner)s? (?:reserves?|retains?) all rights", "rights"),
    ("copyright", 6, 0.4, r"tous droits réservés", "réservés"),
    ("copyright", 6, 0.4, r"alle rechte vorbehalten", "vorbehalten"),
    ("copyright", 6, 0.4, r"todos los derechos reservados", "reservados"),
)
