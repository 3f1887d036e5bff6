"""Types of all tables, and the constant relations."""

from __future__ import annotations

LINE_ITEM = "struct<description:string,quantity:decimal(12,3),unit_price:decimal(18,2),amount:decimal(18,2),discount_percent:decimal(6,3)>"
INVOICE_FIELDS = {
    "vendor_name": "string", "vendor_tax_id": "string", "invoice_number": "string", "issue_date": "date", "due_date": "date", "currency": "string",
    "subtotal": "decimal(18,2)", "tax_rate": "decimal(6,3)", "tax_amount": "decimal(18,2)", "total": "decimal(18,2)", "line_items": f"array<{LINE_ITEM}>",
}
INVOICE = f"struct<{','.join(f'{k}:{v}' for k, v in INVOICE_FIELDS.items())}>"
ISSUE = "struct<code:string,severity:string,message:string>"
CELL = "struct<text:string,x0:double,x1:double,top:double,bottom:double,size:double,bold:boolean>"
LINES = f"array<struct<cells:array<{CELL}>>>"
PAGE = f"sha256 string, name string, cells array<{CELL}>, width double, height double, source string, ocr_scores array<double>"
EXTRACTION = f"invoice {INVOICE}, method string, confidence double, raw_text string, notes array<string>, conflicts array<string>"
FILES = f"sha256 string, name string, seq long, status string, invoice_key string, method string, confidence double, issues array<{ISSUE}>, notes array<string>, invoice {INVOICE}, processed_at timestamp"
VENDORS = "tax_id string, name string, source string"
OUTBOX = "sheet string, row_key string, row string, row_hash string, synced_hash string"
LABEL = f"file string, layout string, scanned boolean, defect string, expected_issues array<string>, expected_status string, duplicate_of string, invoice {INVOICE}"
SECOND_READING = "struct<vendor_name:string,vendor_tax_id:string,invoice_number:string,issue_date:string,due_date:string,currency:string,subtotal:string,tax_rate:string,tax_amount:string,total:string,line_items:array<struct<description:string,quantity:string,unit_price:string,amount:string>>>"

# Fields, sheet headers, severities, codes.
REQUIRED = ["vendor_name", "vendor_tax_id", "invoice_number", "issue_date", "currency", "total"]
MONEY = ["subtotal", "tax_amount", "total"]
INVOICE_HEADER = ["key", "status", "vendor_name", "vendor_tax_id", "invoice_number", "issue_date", "due_date", "currency", "subtotal", "tax_rate", "tax_amount", "total", "line_count", "issues", "notes", "source_file", "method"]
LINE_HEADER = ["key", "invoice_key", "line", "description", "quantity", "unit_price", "amount", "currency"]
SUSPICIOUS = ["INVALID_TAX_ID", "LINE_AMOUNT_MISMATCH", "LINES_SUM_MISMATCH", "TAX_MISMATCH", "TOTAL_MISMATCH", "NO_LINE_ITEMS", "LOW_CONFIDENCE", "DUE_BEFORE_ISSUE", "FUTURE_DATE"]

# Currencies, in the order in which symbols are looked for.
CURRENCY_SYMBOLS = {"£": "GBP", "€": "EUR", "$": "USD", "¥": "JPY"}
CURRENCY_CODES = ["EUR", "USD", "GBP", "CHF", "PLN", "SEK", "DKK", "NOK", "CZK", "HUF", "CAD", "AUD", "AZN", "TRY", "JPY"]
EUROZONE = ["AT", "BE", "CY", "DE", "EE", "ES", "FI", "FR", "GR", "EL", "HR", "IE", "IT", "LT", "LU", "LV", "MT", "NL", "PT", "SI", "SK"]

# Month words, folded, and their numbers.
MONTHS = {
    "jan": 1, "januar": 1, "janv": 1, "gen": 1, "gennaio": 1, "ene": 1, "enero": 1,
    "feb": 2, "februar": 2, "fevr": 2, "febbraio": 2,
    "mar": 3, "marz": 3, "mars": 3, "marzo": 3, "mrt": 3, "maart": 3,
    "apr": 4, "avr": 4, "aprile": 4, "abr": 4,
    "may": 5, "mai": 5, "maggio": 5, "mayo": 5, "mei": 5,
    "jun": 6, "juni": 6, "juin": 6, "giugno": 6, "junio": 6,
    "jul": 7, "juli": 7, "juil": 7, "luglio": 7, "julio": 7,
    "aug": 8, "aout": 8, "ago": 8, "agosto": 8,
    "sep": 9, "sept": 9, "set": 9, "settembre": 9, "septiembre": 9,
    "oct": 10, "okt": 10, "ott": 10, "ottobre": 10, "octubre": 10,
    "nov": 11, "novembre": 11, "noviembre": 11,
    "dec": 12, "dez": 12, "dic": 12, "dicembre": 12, "diciembre": 12,
}

# Labels of fields in six languages, folded.
LABELS = {
    "invoice_number": [
        "invoiceno", "invoicenumber", "invoice#", "invoiceid", "inv#", "invno", "rechnungsnummer", "rechnungsnr", "rechnung-nr",
        "rechnungnr", "facturen°", "facturen", "facturenº", "numerodefacture", "nfacture", "n°facture", "fatturan", "fatturanr",
        "numerofattura", "fatturan.", "facturanº", "numerodefactura", "nºfactura", "facturanum", "factuurnummer", "factuurnr",
    ],
    "issue_date": [
        "invoicedate", "dateofissue", "issuedate", "issued", "date", "rechnungsdatum", "datum", "dated'emission",
        "datedefacture", "datedefacturation", "datafattura", "data", "fechadefactura", "fechadeemision", "fecha", "factuurdatum",
    ],
    "due_date": [
        "duedate", "due", "paymentdue", "payby", "falligam", "fallig", "falligkeit", "zahlbarbis", "echeance", "dated'echeance",
        "datedecheance", "scadenza", "datascadenza", "vencimiento", "fechadevencimiento", "vervaldatum", "uiterlijkbetalen",
    ],
    "vendor_tax_id": [
        "vatregno", "vatregistrationnumber", "vatno", "vatnumber", "vatid", "vatreg", "taxid", "ein", "ust-idnr", "ustidnr",
        "ust-id", "ustid", "steuernummer", "mwst-nr", "mwstnr", "uid", "uid-nr", "n°tva", "ntva", "numerotva",
        "tvaintracommunautaire", "n°tvaintracom", "partitaiva", "p.iva", "piva", "nif", "cif", "btw-nummer", "btwnummer",
        "btw-nr", "btwnr",
    ],
    "subtotal": [
        "subtotal", "sub-total", "netamount", "totalnet", "totalexcl", "totalexclvat", "net", "nettobetrag", "netto",
        "summenetto", "zwischensumme", "zwischentotal", "totalht", "sous-total", "imponibile", "totaleimponibile",
        "baseimponible", "subtotaal", "totaalexcl",
    ],
    "tax_amount": [
        "vat", "salestax", "tax", "gst", "mwst", "zzgl.mwst", "zzgl.ust", "ust", "umsatzsteuer", "tva", "montanttva", "iva",
        "btw",
    ],
    "total": [
        "totaldue", "balancedue", "amountdue", "grandtotal", "total", "totalamount", "invoicetotal", "gesamtbetrag",
        "gesamtsumme", "rechnungsbetrag", "endbetrag", "gesamt", "totalttc", "netapayer", "montantttc", "totale",
        "totaledocumento", "totaleapagare", "totalfactura", "importetotal", "totaal", "totaalbedrag", "tebetalen",
    ],
}
# Words of document titles and of table headers, folded; words that announce a discount column.
TITLES = [
    "invoice", "rechnung", "facture", "fattura", "factura", "factuur", "taxinvoice", "billto",
]
HEADER_WORDS = [
    "description", "item", "items", "qty", "quantity", "unitprice", "price", "rate", "amount", "total", "pos", "pos.",
    "beschreibung", "bezeichnung", "menge", "anzahl", "einzelpreis", "betrag", "gesamt", "designation", "qte", "prixunitaireht",
    "prixunitaire", "montantht", "montant", "descrizione", "quantita", "qta", "prezzo", "prezzounitario", "importo",
    "omschrijving", "aantal", "prijs", "bedrag", "concepto", "cantidad", "precio", "importe",
]
DISCOUNT_WORDS = ["dto", "discount", "rabatt", "sconto", "remise", "korting", "desc."]

# National tax-id formats after the country prefix, and prefixes looked for inside glued words.
TAX_FORMATS = {"AT": r"U\d{8}", "BE": r"[01]\d{9}", "ES": r"[0-9A-Z]\d{7}[0-9A-Z]", "IT": r"\d{11}", "NL": r"\d{9}B\d{2}", "PL": r"\d{10}", "SE": r"\d{12}", "DK": r"\d{8}", "IE": r"\d{7}[A-Z]{1,2}"}
TAX_ID = r"\b(CHE-?\d{9}|[A-Z]{2}(?=[0-9A-Z]*\d{6})[0-9A-Z]{8,12}|\d{2}-\d{5,8})\b"
VAT_PREFIXED = r"((?:AT|BE|BG|CY|CZ|DE|DK|EE|EL|ES|FI|FR|GB|HR|HU|IE|IT|LT|LU|LV|MT|NL|PL|PT|RO|SE|SI|SK|CH|NO)(?=[0-9A-Z]*\d{6})[0-9A-Z]{8,12})\b"

# What a sink reports as worth another try.
RETRYABLE = {408, 429, 500, 502, 503, 504}
