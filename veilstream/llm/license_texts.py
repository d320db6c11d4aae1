"""Parts of public license texts, as templates of the license scan.

A template is (label, required phrase, text). The text is compared as a set of words; a phrase that isn't empty has to stand in
the block word for word, so that texts which differ in a version or a clause are told apart. Wording that
several licenses share has a label of its own.
"""

from __future__ import annotations

# Public license texts and notices, in the order of their labels.
TEMPLATES = [
    ("agpl-3.0-text", "affero general public license", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("agpl-notice", "affero general public license", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-notice", "affero general public license", "licensed under the GNU Affero General Public License"),
    ("apache-2.0-notice", "apache license version 2 0", "licensed under the Apache License, Version 2.0"),
    ("apache-2.0-notice", "apache license version 2 0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0-text", "", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache-2.0-text", "", "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License."),
    ("apache-2.0-text", "", "\"Legal Entity\" shall mean the union of the acting entity and all other entities that control, are controlled by, or are under common control with that entity."),
    ("apache-2.0-text", "", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("apache-2.0-text", "", "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work"),
    ("apache-2.0-text", "", "You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions"),
    ("apache-2.0-text", "", "This License does not grant permission to use the trade names, trademarks, service marks, or product names of the Licensor, except as required for reasonable and customary use in describing the origin of the Work and reproducing the content of the NOTICE file."),
    ("bsd-3-clause-text", "", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-disclaimer", "", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("bsd-disclaimer", "", "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)"),
    ("bsd-disclaimer", "", "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsd-notice", "bsd license", "released under the BSD license"),
    ("bsd-notice", "bsd style license", "governed by a BSD-style license that can be found in the LICENSE file"),
    ("bsd-text", "", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-text", "", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-text", "", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsl-1.0-text", "", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("cc-by-4.0-notice", "cc by 4 0", "licensed under CC BY 4.0"),
    ("cc-by-4.0-notice", "creative commons attribution 4 0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0-notice", "cc by nc 4 0", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0-notice", "creative commons attribution noncommercial 4 0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-nd-4.0-notice", "cc by nc nd 4 0", "licensed under CC BY-NC-ND 4.0"),
    ("cc-by-nc-sa-4.0-notice", "cc by nc sa 4 0", "licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nd-4.0-notice", "cc by nd 4 0", "licensed under CC BY-ND 4.0"),
    ("cc-by-sa-3.0-notice", "cc by sa 3 0", "licensed under CC BY-SA 3.0"),
    ("cc-by-sa-4.0-notice", "cc by sa 4 0", "licensed under CC BY-SA 4.0"),
    ("cc-by-sa-4.0-notice", "creative commons attribution sharealike 4 0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-text", "", "You must give appropriate credit, provide a link to the license, and indicate if changes were made. You may do so in any reasonable manner, but not in any way that suggests the licensor endorses you or your use."),
    ("cc0-text", "", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law"),
    ("gpl-2.0-notice", "general public license version 2", "licensed under the GNU General Public License version 2"),
    ("gpl-2.0-notice", "gnu general public license as published by the free software foundation either version 2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3.0-notice", "gnu general public license version 3", "this work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0-notice", "gnu general public license as published by the free software foundation either version 3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-3.0-text", "the gnu general public license is a free copyleft license", "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works."),
    ("gpl-disclaimer", "", "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl-text", "", "When we speak of free software, we are referring to freedom, not price. Our General Public Licenses are designed to make sure that you have the freedom to distribute copies of free software (and charge for them if you wish), that you receive source code or can get it if you want it"),
    ("gpl-text", "", "For example, if you distribute copies of such a program, whether gratis or for a fee, you must pass on to the recipients the same freedoms that you received. You must make sure that they, too, receive or can get the source code. And you must show them these terms so they know their rights."),
    ("gpl-text", "", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("isc-text", "", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl-2.1-notice", "lesser general public license as published by the free software foundation either version 2 1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-3.0-notice", "lesser general public license as published by the free software foundation either version 3", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-notice", "lesser general public license", "GNU Lesser General Public License"),
    ("mit-notice", "mit license", "released under the MIT license"),
    ("mit-notice", "mit license", "licensed under the MIT license"),
    ("mit-text", "", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit-text", "", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit-disclaimer", "", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("mit-disclaimer", "", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mpl-2.0-notice", "mozilla public license v 2 0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense-text", "", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib-text", "", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("zlib-text", "", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required."),
]
