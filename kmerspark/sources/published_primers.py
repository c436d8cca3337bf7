"""Published primer pairs by clade, a line each.

Columns: panel, gene, region, index (- for none), forward, reverse, least and greatest product
length, least count, mismatches, trim.
"""

CLADES = {
    "angiospermae": ("1.0.0", "Magnoliopsida"),
    "bacteria": ("1.0.0", "Bacteria"),
    "c_elegans": ("1.0.0", "Caenorhabditis elegans"),
    "cnidaria": ("1.1.0", "Cnidaria"),
    "human": ("1.0.1", "Homo sapiens"),
    "hydrozoa": ("1.0.7", "Hydrozoa"),
    "insecta": ("1.0.0", "Insecta"),
    "metazoa": ("1.0.0", "Metazoa"),
    "teleostei": ("1.0.0", "Teleostei"),
}

PAIRS = """
angiospermae psbA-trnH - - GTTATGCATGAACGTAATGCTC CGCGCATGGTGGATTCACAATCC 100 700 2 2 15
angiospermae rpl36-infA-rps8 - - CACAAATTTTACGAACGAAG TAATGACAGAYCGAGARGCTCGAC 400 600 2 2 15
angiospermae trnK-rps16 - - TACTCTACCRTTGAGTTAGCAAC AAAGGKGCTCAACCTACARGAAC 500 900 2 2 15
angiospermae trnV-atpE - - GTGTAAACGAGTTGCTCTACCA CGACATTTGCACATTTAGATGCTAC 400 1000 2 2 15
angiospermae trnC-ycf6 - - CCAGTTCAAATCTGGGTGTC CCCAAGCAAGACTTACTATATCC 100 1200 2 2 15
angiospermae ycf6-psbM - - GGATATAGTAAGTCTTGCTTGGG TTCTTGCATTTATTGCTACTGC 300 1600 2 2 15
angiospermae psbM-trnD - - GCGGTAGGAACTAGAATAAATAG GGGATTGTAGTTCAATTGGT 500 1400 2 2 15
angiospermae atpB-rbcL - - AGAAGTAGTAGGATTGATTCTCATA GAATCCAACACTTGCTTTAGTCTCT 500 1000 2 2 15
angiospermae trnL-F - - GGTTCAAGTCCCTCTATCCC ATTTGAACTGGTGACACGAG 200 600 2 2 15
angiospermae ITS - - CCTTATCATTTAGAGGAAGGAG TCCTCCGCTTATTGATATGC 400 900 2 2 15
bacteria 16S 341F-785R - CCTACGGGNGGCWGCAG GACTACHVGGGTATCTAATCC 200 500 2 2 15
bacteria 16S PRK341F-PRK806R - CCTACGGGRBGCASCAG GGACTACYVGGGTATCTAAT 200 500 2 2 15
bacteria 16S 515F-806R - GTGCCAGCMGCCGCGGTAA GGACTACHVGGGTWTCTAAT 200 500 2 2 15
bacteria 16S 515F-806RB - GTGCCAGCMGCCGCGGTAA GGACTACNVGGGTWTCTAAT 200 500 2 2 15
bacteria 16S 68F-783Rabc - TNANACATGCAAGTCGRRCG CTACCAGGGTATCTAATCCTG 200 500 2 2 15
bacteria 16S 341F-783Rabc - CCTACGGGNGGCWGCAG CTACCAGGGTATCTAATCCTG 200 500 2 2 15
c_elegans 16S - - AAGATAAGTCTTCGGAAATT GAATTAAACTAATATCAC 200 350 2 1 15
c_elegans CO1 - - TAATCATAAAGATAT GGATGACCAAAAAATCAAA 550 800 2 1 15
c_elegans 18S - - TACCTGATTGATTCTGTCAGC TGATCCAGCTGCAGGTTCACCTAC 1500 1900 2 1 15
c_elegans 28S - - CCTTAGTAACGGCGAGT TCTCAAATGGTAGCTTCA 2700 3500 2 1 15
c_elegans ITS - 1 TACACACCGCCCGTCGCTATCC ACTCGCCGTTACTAAGG 1000 1500 2 1 15
c_elegans ITS - 2 GTAGGTGAACCTGCAGCTGGATCA ACTCGCCGTTACTAAGG 900 1300 2 1 15
c_elegans EF1A - - GGACGTGTTGAGACCGGAAT TGACGGAGACGTTCTTGACG 100 250 2 1 15
c_elegans H3 - - ATGGCTCGTACCAAGCAAACCGC ATGTCCTTTGGCATGATGGTGAC 350 550 2 1 15
cnidaria 16S - - GRCTGTTTACCAAAAACATA AATTCAACATMGAGG 500 700 2 2 15
cnidaria CO1 - - WAAYCATAAAGATAT GGRTGMCCAAAAAACCARA 600 800 2 2 18
cnidaria 18S - - AACCTGGTTGATCCTGCCAGT TGATCCTTCTGCAGGTTCACCTAC 1600 2000 2 2 15
cnidaria 28S - 1 CCYYAGTAACGGCGAGT SWACAGATGGTAGCTTCG 2900 3500 2 2 15
cnidaria ITS - 1 TACACACCGCCCGTCGCTACTA ACTCGCCGTTACTRRGG 600 1000 2 2 15
cnidaria ITS - 2 GTAGGTGAACCTGCAGAAGGATCA ACTCGCCGTTACTRRGG 600 1000 2 2 15
cnidaria 28S - 2 CGTGAAACCGYTRRAAGGG TTGGTCCGTGTTTCAAGACG 300 700 2 2 15
human mt 1404-3947 - ACTTAAGGGTCGAAGGTGGATT TCGATGTTGAAGCCTGAGACTA 2400 2600 2 2 15
human mt 3734-6739 - AAGTCACCCTAGCCATCATTCTA GATATCATAGCTCAGACCATACC 2800 3200 2 2 15
human mt 6511-9220 - CTGCTGGCATCACTATACTACTA GATTGGTGGGTCATTATGTGTTG 2500 2900 2 2 15
human mt 8910-10648 - CTTACCACAAGGCACACCTACA GGCACAATATTGGCTAAGAGGG 1600 1900 2 2 15
human mt 10360-12226 - GTCTGGCCTATGAGTGACTACA CAGTTCTTGTGAGCTTTCTCGG 1700 2000 2 2 15
human mt 11977-13830 - CTCCCTCTACATATTTACCACAAC AAGTCCTAGGAAAGTGACAGCGA 1700 2000 2 2 15
human mt 13477-15349 - GCAGGAATACCTTTCCTCACAG GTGCAAGAATAGGAGGTGGAGT 1600 2000 2 2 15
human mt 14898-151 - TAGCCATGCACTACTCACCAGA GGATGAGGCAGGAATCAAAGAC 1700 2000 2 2 15
human mt 16488-1677 - CTGTATCCGACATCTGGTTCCT GTTTAGCTCAGAGCGGTCAAGT 1600 1900 2 2 15
hydrozoa 16S - - GRCTGTTTAMCAAAAACATA AATTSAWSMTMGAGG 500 700 2 2 15
hydrozoa CO1 - - GGTCAACAAATCATAAAGATATTGG TAAACTTCAGGGTGACCAAAAAATCA 580 750 2 2 18
hydrozoa 18S - - AACCTGGTTGATCCTGCCAGT TGATCCTTCCGCAGGTTCACCTAC 1600 2000 2 2 15
hydrozoa 28S - - CCYYAGTAACGGCGAGT SWACAGATGGTAGCTTCG 2900 3500 2 2 15
insecta 12S - - ACTWTGTTACGACTTDTY AGGATTAGATACCCTDBT 300 500 2 2 15
insecta 16S - 1 TARTYCAACATCGRGGTC CYGTRCDAAGGTAGCATA 300 500 2 2 15
insecta CO1 - 1 HCCHGAYATRGCHTTYCC TATDGTRATDGCHCCNGC 300 500 2 2 15
insecta CO2 - 1 GGNCRHCARTGRTAYTGA RATYTCDGARCAYTGNCC 200 400 2 2 15
insecta CytB - - NCAAATRTCNTTHTGRGG YCAYTCDGGYTKRATRTG 300 500 2 2 15
insecta ND1 - - ATHARYTTATCRTANCGR NTTYGAYTTTKCDGARGG 150 300 2 2 15
insecta ND4 - - HGGDGCYTCNACATGDGC RGGNTAYCARCCDGARCG 150 300 2 2 15
insecta ND5 - - RTCYYTNGARTAAAAHCC NGCHAAYTWTGARTWTGA 200 400 2 2 15
insecta 16S - 2 CCGGTTTGAACTCAGATCACGT CGCCTGTTTAACAAAAACAT 400 600 2 2 15
insecta CO1 - 2 CAACATTTATTTTGATTTTTTGG TYCATTGCACTAATCTGCCATATTAG 700 950 2 2 15
insecta CO2 - 2 ATGGCAGATTAGTGCAATGG GTTTAAGAGACCAGTACTTG 600 850 2 2 15
insecta NADH - - AGCTATTGGGTTCAGACCCC GAAGTTTGGTTTAAACCTCC 400 600 2 2 15
insecta Fz4 - - GCGTCTTTCTATTGCGCTACTAT GCTTGTACGGACTGCTGATTATT 800 1100 2 2 15
insecta Gpdh - - CCCGACCTGGTTGAGGCTGCCAAGAATGC ACATATGCTCAGGGTGATTGCGTATGCA 900 1200 2 2 15
insecta Pgi - - GCCATGTTCTSYGGMCAGCAYAT TAACGACCTCCNACCCARTCCCA 500 800 2 2 15
insecta Yp2 - - CAGCAGCGTTACAATCTCCAGCC CCGAAGGGGCTCTTGGAGTTCAC 600 900 2 2 15
insecta 18S - 1 CTGGTGCCAGCAGCCGCGGYAA TCCGTCAATTYCTTTAAGTT 600 900 2 2 15
insecta 28S - - GGGAAAGAAGACCCTGTTGAG GCTTGGCBGCCACAAGCCAGTTA 600 900 2 2 15
insecta 18S - 2 AACCTGGTTGATCCTGCCAGT TGATCCTTCTGCAGGTTCACCTAC 1600 2000 2 2 15
insecta ITS - 1 TACACACCGCCCGTCGCTACTA ACTCGCCGTTACTRRGG 600 1000 2 2 15
insecta ITS - 2 GTAGGTGAACCTGCAGAAGGATCA ACTCGCCGTTACTRRGG 600 1000 2 2 15
metazoa 18S V3 - AACGGCTACCACATCCAAGG CACCAGACTTGCCCTCCAAT 50 300 2 2 15
metazoa 18S V5-V7S - TGACGGAAGGGCACCACCAG TCCACCAACTAAGAACGGCC 50 300 2 2 15
metazoa 18S V5-V7L - AAACGATGCCGACTAGCGAT TCCACCAACTAAGAACGGCC 50 300 2 2 15
metazoa 18S V7 - GGCCGTTCTTAGTTGGTGGA TGCGGCCCAGAACATCTAAG 50 300 2 2 15
metazoa 18S V7p-V8 - AACAGGTCTGTGATGCCCTT TGTGTACAAAGGGCAGGGAC 50 300 2 2 15
metazoa 18S V9 1 CTTTGTACACACCGCCCGTC CCTTGTTACGACTTTTACTTCCTCT 50 300 2 2 15
metazoa 18S V9 2 CCCTGCCHTTTGTACACAC CCTTCYGCAGGTTCACCTAC 1 300 2 2 15
teleostei 18S - - TAACATATGCTTGTCTCAAAG CCTGTATTGTTATTTTTCGTCAC 300 700 2 2 15
teleostei 16S - - CGCCTGTTTATCAAAAACAT CCGGTCTGAACTCAGATCACGT 400 700 2 2 15
teleostei CO1 - - TCAACCAACCACAAAGACATTGGCAC TAGACTTCTGGGTGGCCAAAGAATCA 500 800 2 2 15
teleostei CytB - - AAAGCTTCCATCCAACATCTCAGCATGATGAAA AAACTGCAGCCCCTCAGAATGATATTTGTCCTCA 300 600 2 2 15
teleostei 12S - - ACTGGGATTAGATACCCCACTATG GAGAGTGACGGGCGGTGT 200 500 2 2 15
"""
