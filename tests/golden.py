"""Published graphs (fixed values): weighted edges, then degree, betweenness and size of each node."""

BEFORE = """
Tetracycline|SEROTYPE:Typhimurium|1.5972013993003498
Tetracycline|SEROTYPE:Kentucky|1.2304815334268349
Tetracycline|SEROTYPE:Meleagridis|1.0379572118702554
Tetracycline|SEROTYPE:Dublin|2.414235920014676
SEROTYPE:Typhimurium|Ceftriaxone|1.6464148877941982
SEROTYPE:Typhimurium|Chloramphenicol|1.915360501567398
SEROTYPE:Typhimurium|Trimethoprim-Sulfamethoxazole|2.593103448275862
SEROTYPE:Typhimurium|Ampicillin|2.593103448275862
SEROTYPE:Typhimurium|Sulfisoxazole|2.295977011494253
SEROTYPE:Typhimurium|Cefoxitin|1.7580362361192285
SEROTYPE:Typhimurium|Amoxicillin-Clavulanic Acid|1.6206896551724137
Nalidixic acid|SEROTYPE:Dublin|4.3268124280782505
Nalidixic acid|SEROTYPE:Meleagridis|1.6277056277056277
SEROTYPE:Dublin|Gentamicin|4.7594936708860756
SEROTYPE:Dublin|Chloramphenicol|3.7318757192174914
SEROTYPE:Dublin|Ampicillin|3.510126582278481
SEROTYPE:Dublin|Sulfisoxazole|3.520042194092827
SEROTYPE:Dublin|Cefoxitin|3.7107916756060932
SEROTYPE:Dublin|Trimethoprim-Sulfamethoxazole|2.8556962025316457
SEROTYPE:Dublin|Ciprofloxacin|4.362869198312236
SEROTYPE:Dublin|Amoxicillin-Clavulanic Acid|3.7927215189873418
SEROTYPE:Dublin|Ceftriaxone|3.7773759292746636
SEROTYPE:Meleagridis|Trimethoprim-Sulfamethoxazole|3.580952380952381
SEROTYPE:Meleagridis|Ciprofloxacin|1.492063492063492
"""

AFTER = """
Tetracycline|SEROTYPE:Typhimurium|1.8115509086382873
Tetracycline|SEROTYPE:Dublin|3.2080715781458213
SEROTYPE:Typhimurium|Ceftriaxone|1.6997041420118344
SEROTYPE:Typhimurium|Nalidixic acid|1.8413461538461537
SEROTYPE:Typhimurium|Gentamicin|1.0911680911680912
SEROTYPE:Typhimurium|Chloramphenicol|2.1151873767258382
SEROTYPE:Typhimurium|Trimethoprim-Sulfamethoxazole|9.820512820512821
SEROTYPE:Typhimurium|Ampicillin|2.3759305210918114
SEROTYPE:Typhimurium|Sulfisoxazole|2.618803418803419
SEROTYPE:Typhimurium|Cefoxitin|1.7676923076923077
SEROTYPE:Typhimurium|Ciprofloxacin|1.8413461538461537
SEROTYPE:Typhimurium|Amoxicillin-Clavulanic Acid|1.6676342525399128
Nalidixic acid|SEROTYPE:Dublin|6.10171568627451
SEROTYPE:Dublin|Gentamicin|6.675381263616558
SEROTYPE:Dublin|Chloramphenicol|4.968024132730015
SEROTYPE:Dublin|Ampicillin|4.966160657811511
SEROTYPE:Dublin|Sulfisoxazole|4.405751633986928
SEROTYPE:Dublin|Cefoxitin|5.557254901960785
SEROTYPE:Dublin|Ciprofloxacin|6.10171568627451
SEROTYPE:Dublin|Amoxicillin-Clavulanic Acid|5.526082130965594
SEROTYPE:Dublin|Ceftriaxone|5.487933634992459
"""

NODES_BEFORE = """
Tetracycline|0.29|0.18|6.279876064612116
SEROTYPE:Typhimurium|0.57|0.21|16.019886587999565
SEROTYPE:Kentucky|0.07|0.0|1.2304815334268349
SEROTYPE:Meleagridis|0.29|0.05|7.738678712591756
SEROTYPE:Dublin|0.79|0.56|40.76204103927978
Ceftriaxone|0.14|0.0|5.423790817068862
Chloramphenicol|0.14|0.0|5.647236220784889
Trimethoprim-Sulfamethoxazole|0.21|0.04|9.02975203175989
Ampicillin|0.14|0.0|6.103230030554343
Sulfisoxazole|0.14|0.0|5.81601920558708
Cefoxitin|0.14|0.0|5.468827911725322
Amoxicillin-Clavulanic Acid|0.14|0.0|5.413411174159755
Nalidixic acid|0.14|0.02|5.954518055783878
Gentamicin|0.07|0.0|4.7594936708860756
Ciprofloxacin|0.14|0.02|5.854932690375728
"""

NODES_AFTER = """
Tetracycline|0.17|0.0|5.019622486784108
SEROTYPE:Typhimurium|0.92|0.51|28.65087614687663
SEROTYPE:Dublin|0.83|0.34|52.99809130675868
Ceftriaxone|0.17|0.0|7.1876377770042925
Nalidixic acid|0.17|0.0|7.943061840120663
Gentamicin|0.17|0.0|7.766549354784649
Chloramphenicol|0.17|0.0|7.083211509455854
Trimethoprim-Sulfamethoxazole|0.08|0.0|9.820512820512821
Ampicillin|0.17|0.0|7.342091178903322
Sulfisoxazole|0.17|0.0|7.0245550527903475
Cefoxitin|0.17|0.0|7.324947209653092
Ciprofloxacin|0.17|0.0|7.943061840120663
Amoxicillin-Clavulanic Acid|0.17|0.0|7.193716383505507
"""


def edges(text):
    return [(a, b, float(w)) for a, b, w in (line.split("|") for line in text.strip().splitlines())]


def nodes(text):
    rows = (line.split("|") for line in text.strip().splitlines())
    return {n: (float(d), float(b), float(s)) for n, d, b, s in rows}
