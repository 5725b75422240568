"""A tape of two sell legs under one basket, and an order that is turned down.

The first leg has a refused replace, a fill that is doubted and busted, a fill
and its resend; the second is cancelled. Expectations in ``test_golden`` follow
from the rules, message by message.
"""

LEG_A, LEG_B = "1=FUND9|55=VOD|54=2|38=500|", "1=FUND9|55=VOD|54=2|38=400|"
TAPE = [
    "35=D|34=1|49=DESK|56=VENUE|52=20250303-08:00:00.000|11=BSK77|1=FUND9|55=VOD|54=2|38=900|40=1|59=0|",
    f"35=D|34=2|11=LEGA|526=BSK77|{LEG_A}40=2|44=71.20|",
    f"35=8|34=3|11=LEGA|526=BSK77|37=V-100|17=X1|20=0|150=0|39=0|{LEG_A}14=0|151=500|",
    "35=G|34=4|11=LEGA.1|41=LEGA|37=V-100|1=FUND9|55=VOD|54=2|38=450|40=2|44=71.10|",
    "35=9|34=5|11=LEGA.1|41=LEGA|37=V-100|39=0|434=2|102=2|58=price band|",
    f"35=D|34=6|11=LEGB|526=BSK77|{LEG_B}40=2|44=71.05|",
    f"35=8|34=7|11=LEGB|526=BSK77|37=V-200|17=X2|20=0|150=0|39=0|{LEG_B}14=0|151=400|",
    f"35=8|34=8|11=LEGA|526=BSK77|37=V-100|17=X3|20=0|150=1|39=1|{LEG_A}32=200|31=71.20|14=200|151=300|6=71.20|",
    "35=F|34=9|11=LEGB.C|41=LEGB|37=V-200|1=FUND9|55=VOD|54=2|38=400|",
    f"35=8|34=10|11=LEGB.C|41=LEGB|526=BSK77|37=V-200|17=X4|20=0|150=4|39=4|{LEG_B}14=0|151=0|",
    "35=Q|34=11|37=V-100|17=X3|127=C|1=FUND9|55=VOD|54=2|58=unknown fill|",
    f"35=8|34=12|11=LEGA|37=V-100|17=X5|20=1|19=X3|150=0|39=0|{LEG_A}14=0|151=500|6=0|",
    f"35=8|34=13|11=LEGA|526=BSK77|37=V-100|17=X6|20=0|150=2|39=2|{LEG_A}32=500|31=71.25|14=500|151=0|6=71.25|",
    f"35=8|34=14|43=Y|11=LEGA|526=BSK77|37=V-100|17=X6|20=0|150=2|39=2|{LEG_A}32=1|31=1|14=9999|151=1|6=1|",
    "35=H|34=15|11=LEGA|37=V-100|1=FUND9|55=VOD|54=2|",
    "35=D|34=16|11=SOLO|1=FUND3|55=TSCO|54=1|38=70|40=2|44=2.95|",
    "35=8|34=17|11=SOLO|37=V-300|17=X7|20=0|150=8|39=8|1=FUND3|55=TSCO|54=1|38=70|14=0|151=0|103=3|58=limit breach|",
]


def messages(spark):
    rows = [(k + 1, raw) for k, raw in enumerate(TAPE)]
    return spark.createDataFrame(rows, "seq bigint, raw string").selectExpr("seq", "timestamp_ntz'2025-03-03 08:00:00' + make_dt_interval(0, 0, 0, seq) AS ts", "raw")
