"""What invoices call their fields."""

from __future__ import annotations

# Fixed values: (language, field, pattern, base confidence), in the order in which matches are reported.
_EURO = r"€?\s*([0-9]{1,3}(?:[.,][0-9]{3})*[.,][0-9]{2})\s*€?"
_EURO_COMMA = r"€?\s*([0-9]{1,3}(?:\.[0-9]{3})*,[0-9]{2})\s*€?"
_POUND = r"[$£]?\s*([0-9]{1,3}(?:,[0-9]{3})*\.[0-9]{2})\s*[$£]?"
_SLASHED = r"([0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4})"
_DOTTED = r"([0-9]{1,2}[.\-][0-9]{1,2}[.\-][0-9]{2,4})"
_NUMBER = r"([A-Z0-9][A-Z0-9\-/]*)"
PATTERNS = (
    ("es", "invoice_number", rf"(?:Factura|FACTURA|Fac\.?)\s+(?:N[úuº°]?\.?|Número)\s*:?\s*{_NUMBER}", 0.9),
    ("es", "invoice_date", rf"(?:Fecha(?:\s+de\s+emisión)?|FECHA):?\s*{_SLASHED}", 0.85),
    ("es", "due_date", rf"(?:Vencimiento|Fecha\s+de\s+vencimiento|VENCIMIENTO):?\s*{_SLASHED}", 0.85),
    ("es", "total_amount", rf"(?:Total|TOTAL|Importe\s+Total):?\s*{_EURO}", 0.9),
    ("es", "tax_amount", rf"(?:IVA|I\.V\.A\.|Impuesto).*?:?\s*{_EURO}", 0.85),
    ("es", "net_amount", rf"(?:Base\s+Imponible|Base):?\s*{_EURO}", 0.85),
    ("es", "net_amount", rf"(?:Neto|NETO|Subtotal|SUBTOTAL|Suma\s+Neta):?\s*{_EURO}", 0.80),
    ("es", "vat_number", r"(?:CIF|NIF|N\.I\.F\.|C\.I\.F\.):?\s*([A-Z]?[0-9]{8}[A-Z0-9])", 0.9),
    ("es", "customer_name", r"(?:Cliente|CLIENTE|Facturar\s+a|FACTURAR\s+A|Destinatario|DESTINATARIO|A\s+la\s+atención\s+de|Att\.?|Attn\.?):?\s*([A-ZÀ-ÿa-z][A-ZÀ-ÿa-z\s\.,&\-]{2,80})", 0.75),
    ("es", "currency", r"(?:Moneda:?\s+)?(€|EUR|USD|GBP|CHF)", 0.7),
    ("en", "invoice_number", rf"(?:Invoice|INVOICE)\s+(?:#|No\.?|Number)\s*:?\s*{_NUMBER}", 0.9),
    ("en", "invoice_date", rf"(?:(?:Invoice\s+)?Date|DATE):?\s*{_SLASHED}", 0.85),
    ("en", "due_date", rf"(?:Due\s+Date|Payment\s+Due|DUE\s+DATE):?\s*{_SLASHED}", 0.85),
    ("en", "total_amount", rf"(?:Total|TOTAL|Amount\s+Due):?\s*{_POUND}", 0.9),
    ("en", "tax_amount", rf"(?:VAT|Tax|V\.A\.T\.).*?:?\s*{_POUND}", 0.85),
    ("en", "net_amount", rf"(?:Subtotal|Net\s+Amount|SUBTOTAL):?\s*{_POUND}", 0.85),
    ("en", "net_amount", rf"(?:Net|NET|Sub-total|SUB-TOTAL|Net\s+Sum):?\s*{_POUND}", 0.80),
    ("en", "net_amount", r"(?:Total\s+excl(?:uding)?\.?\s+VAT|Total\s+ex\.?\s+VAT|Subtotal\s+ex\.?\s+VAT)\s*\n?\s*[$£]?\s*([0-9]{1,3}(?:,[0-9]{3})*\.[0-9]{2})", 0.85),
    ("en", "vat_number", r"(?:VAT\s+(?:No\.?|Reg\.?|Registration)|V\.A\.T\.\s+No\.?):?\s*([A-Z]{2}[0-9]{9,12}|[0-9]{9,12})", 0.9),
    ("en", "customer_name", r"(?:Bill\s+to|BILL\s+TO|Sold\s+to|SOLD\s+TO|Client|CLIENT):[\s:]*([A-Za-z]{3,}\s+[A-Za-z][A-Za-z\s\.,&\-]{2,77})", 0.75),
    ("en", "currency", r"(?:Currency:?\s+)?([$£]|USD|GBP|EUR|CHF)", 0.7),
    ("de", "invoice_number", rf"(?:Rechnungsnummer|Rechnung\s+Nr\.?|Re\.-Nr\.?):?\s*{_NUMBER}", 0.9),
    ("de", "invoice_date", rf"(?:(?:Rechnungs)?datum|DATUM):?\s*{_DOTTED}", 0.85),
    ("de", "due_date", rf"(?:Fälligkeitsdatum|Zahlbar\s+bis|FÄLLIGKEITSDATUM):?\s*{_DOTTED}", 0.85),
    ("de", "total_amount", rf"(?:Gesamtbetrag|Betrag|Summe|GESAMTBETRAG):?\s*{_EURO_COMMA}", 0.9),
    ("de", "tax_amount", rf"(?:MwSt\.?|Umsatzsteuer|USt\.?).*?:?\s*{_EURO_COMMA}", 0.85),
    ("de", "net_amount", rf"(?:Nettobetrag|Zwischensumme|NETTOBETRAG):?\s*{_EURO_COMMA}", 0.85),
    ("de", "net_amount", rf"(?:Netto|NETTO|Summe\s+Netto|Teilsumme|TEILSUMME):?\s*{_EURO_COMMA}", 0.80),
    ("de", "vat_number", r"(?:USt-IdNr\.?|Steuernummer):?\s*(DE[0-9]{9}|[0-9]{2,3}/[0-9]{3}/[0-9]{4,5})", 0.9),
    ("de", "customer_name", r"(?:Kunde|KUNDE|Rechnungsempfänger|RECHNUNGSEMPFÄNGER|An|z\.Hd\.|z\.\s*Hd\.):?\s*([A-Za-zÄÖÜäöüß][A-Za-zÄÖÜäöüß\s\.,&\-]{2,80})", 0.75),
    ("de", "currency", r"(?:Währung:?\s+)?(€|EUR|USD|GBP|CHF)", 0.7),
    ("it", "invoice_number", rf"(?:Fattura\s+N\.?|Numero\s+Fattura|N\.\s+Fatt\.?|FATTURA\s+N\.?):?\s*{_NUMBER}", 0.9),
    ("it", "invoice_date", rf"(?:(?:Data\s+)?Fattura|Data|DATA):?\s*{_SLASHED}", 0.85),
    ("it", "due_date", rf"(?:(?:Data\s+)?Scadenza|SCADENZA):?\s*{_SLASHED}", 0.85),
    ("it", "total_amount", rf"(?:Totale(?:\s+Fattura)?|Importo\s+Totale|TOTALE):?\s*{_EURO_COMMA}", 0.9),
    ("it", "tax_amount", rf"(?:IVA|I\.V\.A\.|Imposta).*?:?\s*{_EURO_COMMA}", 0.85),
    ("it", "net_amount", rf"(?:Imponibile|Subtotale|IMPONIBILE):?\s*{_EURO_COMMA}", 0.85),
    ("it", "net_amount", rf"(?:Netto|NETTO|Somma\s+Netta|Importo\s+Netto):?\s*{_EURO_COMMA}", 0.80),
    ("it", "vat_number", r"(?:P\.IVA|P\.\s*IVA|Partita\s+IVA):?\s*(IT[0-9]{11}|[0-9]{11})", 0.9),
    ("it", "customer_name", r"(?:Cliente|CLIENTE|Fatturare\s+a|FATTURARE\s+A|Spett\.le|Spettabile|SPETTABILE|Destinatario|DESTINATARIO):?\s*([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ\s\.,&\-]{2,80})", 0.75),
    ("it", "currency", r"(?:Valuta:?\s+)?(€|EUR|USD|GBP|CHF)", 0.7),
)

# Words near which a field's value is expected, and what their distance adds.
NEAR = {
    "invoice_number": ("invoice", "factura", "rechnung", "fattura", "number", "número", "nr"),
    "invoice_date": ("date", "fecha", "datum", "data", "invoice date"),
    "due_date": ("due", "vencimiento", "fällig", "scadenza", "payment"),
    "total_amount": ("total", "grand total", "amount due", "gesamtbetrag", "totale"),
    "tax_amount": ("vat", "iva", "mwst", "tax", "impuesto"),
    "net_amount": ("subtotal", "net", "neto", "nettobetrag", "imponibile", "base"),
    "vat_number": ("vat", "cif", "nif", "ust", "partita iva", "tax id"),
    "customer_name": ("bill to", "customer", "client", "cliente"),
}
NEAR_BONUS = ((20, 0.15), (50, 0.10), (100, 0.05))
