"""Authored programs."""

_A = """       IDENTIFICATION DIVISION.
       PROGRAM-ID. ORDERS.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01  WS-ORDER.
           05  WS-ORDER-ID   PIC 9(8).
           05  WS-LINES.
               10  WS-QTY    PIC 9(4).
           05  WS-NAME       PIC X(30).
       01  WS-DONE           PIC X VALUE 'N'.
       COPY ORDER-REC OF SHOPLIB.
      *COPY OLD-REC.
       PROCEDURE DIVISION.
       MAIN-LINE SECTION.
       START-UP.
           OPEN INPUT ORDER-FILE
           PERFORM READ-ORDER
           PERFORM READ-ORDER UNTIL WS-DONE = 'Y'
           GO TO WIND-DOWN.
       READ-ORDER.
           READ ORDER-FILE
           CALL 'PRICE-IT' USING WS-ORDER
           CALL 'PRICE-IT' USING WS-ORDER.
       LOOK-UP SECTION.
       FIND-CUSTOMER.
           EXEC SQL
             SELECT NAME INTO :WS-NAME FROM CUSTOMER
               JOIN ADDRESS ON ID
           END-EXEC
           PERFORM READ-ORDER.
       WIND-DOWN.
           CLOSE ORDER-FILE
           GOBACK.
"""
_B = """       IDENTIFICATION DIVISION.
       PROCEDURE DIVISION.
       SHOW-IT.
           EXEC CICS LINK PROGRAM('MENU') END-EXEC
           CALL WS-TARGET
           PERFORM SHOW-IT
           PERFORM NOT-THERE
           EXEC SQL INCLUDE SQLCA END-EXEC
           EXEC SQL UPDATE STOCK SET N = 1 END-EXEC
           COPY STOCK-REC.
           WRITE OUT-REC.
"""
CLAUSES = """       DATA DIVISION.
       WORKING-STORAGE SECTION.
000100 01  WS-REC.                                                      REMARK1
           05  QTY PIC S9(4) COMP.
           05  TOTAL-X PIC S9(7)V99
               COMP-3
      * a comment in between
               VALUE ZERO.
           05  RATE COMP-2.
           05  TAB OCCURS 1 TO 50 TIMES
               DEPENDING ON QTY INDEXED BY IX.
               10  CELL PIC X(3) VALUE 'A. B'. 10 CELL-2 PIC 9.
           05  AS-TEXT REDEFINES TOTAL-X PIC X(5).
           05  FILLER.
               10  FILLER PIC X.
           88  IS-BIG VALUE 1 THRU 9.
       77  DONE PICTURE IS X VALUE IS "Y.N".
       PROCEDURE DIVISION.
           MOVE 1 TO QTY.
"""
SOURCES = [("orders.cbl", _A), ("show.cbl", _B), ("order-rec.cpy", "       01  R.\n           05  R-ID PIC 9(3).\n"), ("empty.cbl", "")]
