"""Report files with invented names and numbers, in the shapes the parsers must handle."""

MONTHLY = """Hill,,,,
Monthly Sales,,,,
17-Mar-27,,,,
,Year: 2025,,Page 1 of, 2
Month,,Year,Total,
Branch Name: Harbour,,,,
August,,2025,"1,000.50",
September,,2025,"2,000.00",
,Year: 2025,,Page 2 of, 2
Month,,Year,Total,
October,,2025,"3,000.00",
November,,0,"9.00",
December,,2025,-,
,,Total for    2025,"6,000.50",
Branch Name: Hill,,,,
october,,2025,500.00,
REP_S_90909,"Copyright nobody",,,
"""

MENU = """Hill,,,,
Average Sales By Menu,,,,
,Year: 2025 - All Months,,Page 1 of, 1
17-Mar-27,,,,
Menu Name,# Cust,Sales,Avg Customer,
Harbour,,,,
DELIVERY,10.00,200.00,,
take away,30.00,600.00,19.00,
Total By Branch:,40.00,800.00,20.00,
Hill,,,,
TABLE,5.00,100.00,20.00,
TABLE,5.00
"""

ITEMS = """Sales by Items By Group,,,
Branch: Harbour,,,
Division: Hot Coffee,,,
Group: Cups,,,
Description,Barcode,Qty,Amount
Espresso,1,10,"1,500.00"
Oat Milk,2,4,0.00
Total by Group,,14,1500
Group: Beans,,,
Dark Roast,3,2,500.00
Division: Milkshakes,,,
Lost Row,9,1,1.00
Group: Shakes,,,
Vanilla,4,3,500.00
Branch: Hill,,,
Orphan,5,1,10.00
Group: Cakes,,,
Pie,6,7,70.00
"""

ORDERS = """Hill,,,
Customer Orders (Delivery),,,
From Date: 01-Jan-2025,,,
Customer Name,Address,Phone Number,First Order,Last Order,Total,No. of Orders
Harbour,,,,
Person_0001,Street 5,81 111,2025-01-02 10:00,2025-01-05 09:00,"1,200.00",3,
Person_0002,Lane 7,82222,2025-01-04 12:30,,0.00,1,
Total By Branch,,,,,"1,200.00",4
Hill,,,,
Person_0003,Road 9,83333,2025-01-01 08:00,2025-01-06 09:00,"50.00",2,
"""

DETAIL = """Sales by customer in details (delivery),,,
Branch :Harbour,,,
Full Name,Qty,Description,Price
Person_0001,,,
,1,Latte,"5,000.00"
,1,Syrup,0.00
,-1,Cake,3.00
,2,Cake,3.00
Total :,3,,5003.00
Person_0002,,,
,1,Tea,2.00
Branch :Hill,,,
,1,Pie,4.00
Person_0003,,,
,-1,Pie,4.00
Total Branch:,0,,0
"""

PUNCHES = """Hill,,,,,
Time & Attendance Report,,,,,
,17-Mar-27,From Date: 01-Dec-2025 30-Dec-2025,,,
,PUNCH IN,,PUNCH OUT,,Work Duration
,EMP ID :1.0,NAME :Person_0001,,,
,Harbour,,,,
01-Dec-25,,07.00.00,01-Dec-25,15.30.00,08.30.00
06-Dec-25,,22.30.00,07-Dec-25,01.00.00,02.30.00
07-Dec-25,,23.56.59,07-Dec-25,23.57.04,00.00.05
,,,,Total :,11:00:05
,EMP ID :10.0,NAME :Person_0002,,,
,Hill,,,,
02-Dec-25,,13.00.00,02-Dec-25,16.00.00,03.00.00
03-Dec-25,,18.00.00,,
"""

TAX = """Hill,,,,,,,,,
Tax Report,,,,,,,,,
17-Mar-27,,,,,,,,Page 1 of, 1
TAX DESCRIPTION,VAT 11 %,Tax 2,Tax 3,Tax 4,Tax 5,,Service,Total,
Branch Name:  Harbour,,,,,,,,,
Total By Branch,"427.50",0.00,0.00,0.00,,0.00,0.00,"430.00",
Branch Name:  Moon,,,,,,,,,
Total By Branch,"1.00",0.00,0.00,0.00,,0.00,0.00,"1.00",
"""

FILES = {"a_monthly.csv": MONTHLY, "b_menu.csv": MENU, "c_items.csv": ITEMS, "d_orders.csv": ORDERS, "e_detail.csv": DETAIL,
         "f_punches.csv": PUNCHES, "y_unknown.csv": "hello,world\n1,2\n", "z_copy.csv": MONTHLY}


def write(folder, files=FILES, newline="\r\n"):
    for name, text in files.items():
        data = text.replace("\n", newline)
        # The item report is Latin-1, everything else UTF-8.
        if name == "c_items.csv":
            data = data.replace("Vanilla", "Crème")
            (folder / name).write_bytes(data.encode("latin-1"))
        else:
            (folder / name).write_bytes(data.encode("utf-8"))
