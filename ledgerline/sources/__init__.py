from ledgerline.sources.csv_files import read_csv_inferred, read_csv_text, write_csv, write_report
from ledgerline.sources.tables import preview, read_table, register

__all__ = [
    "preview",
    "read_csv_inferred",
    "read_csv_text",
    "read_table",
    "register",
    "write_csv",
    "write_report",
]
