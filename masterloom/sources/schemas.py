"""Columns of the two sources: header in the file -> name in the engine."""

# --- fixed values: file headers ---------------------------------------------

CURATED_HEADERS = {
    "IP Status": "ip_status",
    "Country": "country",
    "Title": "title",
    "Filing Date": "filing_date",
    "Patent/Publication No.": "number",
    "Issue Date": "issue_date",
    "Expiration Date": "expiration_date",
    "Model": "model",
    "Product Line": "product_line",
    "link": "link",
}

BULK_HEADERS = {
    "Patent Number": "number",
    "Title": "title",
    "Abstract": "abstract",
    "Main Text": "main_text",
    "Filing Date": "filing_date",
    "Granted Date": "granted_date",
    "Status": "status",
    "Current Assignee": "current_assignee",
    "Inventors": "inventors",
    "Claims": "claims",
    "Figure URLs": "figure_urls",
}

DATE_HEADERS = ("Filing Date", "Issue Date", "Expiration Date")
