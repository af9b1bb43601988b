"""Seed data of the schema registry as tables: what is known before any document is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Canonical key, alias, data type and family.
ALIASES = (
    ("person.full_name", "candidate_name", "string", "employment"),
    ("person.full_name", "applicant_name", "string", "employment"),
    ("person.full_name", "student_name", "string", "academic"),
    ("person.full_name", "patient_name", "string", "medical"),
    ("person.full_name", "full_name", "string", "identity"),
    ("person.email", "email", "email", "general"),
    ("person.phone", "phone", "phone", "general"),
    ("person.phone", "contact_number", "phone", "general"),
    ("entity.vendor_name", "vendor_name", "string", "financial"),
    ("entity.vendor_name", "supplier_name", "string", "financial"),
    ("entity.vendor_name", "store_name", "string", "financial"),
    ("entity.vendor_name", "merchant_name", "string", "financial"),
    ("entity.vendor_name", "buyer_name", "string", "financial"),
    ("document.reference_number", "invoice_number", "id", "financial"),
    ("document.reference_number", "receipt_number", "id", "financial"),
    ("document.reference_number", "po_number", "id", "financial"),
    ("document.reference_number", "challan_number", "id", "logistics"),
    ("document.date", "invoice_date", "date", "financial"),
    ("document.date", "receipt_date", "date", "financial"),
    ("document.date", "order_date", "date", "financial"),
    ("document.date", "issue_date", "date", "general"),
    ("financial.total_amount", "total_amount", "money", "financial"),
    ("financial.total_amount", "grand_total", "money", "financial"),
    ("financial.total_amount", "amount_due", "money", "financial"),
    ("financial.tax_amount", "tax_amount", "money", "financial"),
    ("financial.tax_amount", "gst_amount", "money", "financial"),
    ("financial.tax_amount", "vat_amount", "money", "financial"),
    ("financial.subtotal_amount", "subtotal_amount", "money", "financial"),
    ("financial.account_number", "account_number", "id", "financial"),
    ("person.account_holder", "account_holder", "string", "financial"),
    ("financial.balance", "balance_amount", "money", "financial"),
)
#: Id, name and family of the schemas.
SCHEMAS = (
    ("sch_commercial_invoice_v1", "Commercial Invoice", "financial"),
    ("sch_purchase_order_v1", "Purchase Order", "financial"),
    ("sch_retail_receipt_v1", "Store / Retail Receipt", "financial"),
    ("sch_bank_statement_v1", "Bank Statement", "financial"),
    ("sch_resume_v1", "Resume / CV", "employment"),
    ("sch_certificate_v1", "Certificate", "academic"),
    ("sch_contract_v1", "Contract / Agreement", "legal"),
    ("sch_delivery_challan_v1", "Delivery Challan", "logistics"),
    ("sch_medical_report_v1", "Medical Report", "medical"),
    ("sch_insurance_v1", "Insurance Document", "financial"),
    ("sch_id_document_v1", "ID Document", "identity"),
    ("sch_expense_report_v1", "Expense Report", "financial"),
    ("sch_application_form_v1", "Application / Form", "general"),
)
#: Schema, key and data type of its fields.
FIELDS = (
    ("sch_commercial_invoice_v1", "vendor_name", "string"),
    ("sch_commercial_invoice_v1", "invoice_number", "id"),
    ("sch_commercial_invoice_v1", "invoice_date", "date"),
    ("sch_commercial_invoice_v1", "subtotal_amount", "money"),
    ("sch_commercial_invoice_v1", "tax_amount", "money"),
    ("sch_commercial_invoice_v1", "total_amount", "money"),
    ("sch_purchase_order_v1", "po_number", "id"),
    ("sch_purchase_order_v1", "order_date", "date"),
    ("sch_purchase_order_v1", "buyer_name", "string"),
    ("sch_purchase_order_v1", "supplier_name", "string"),
    ("sch_purchase_order_v1", "total_amount", "money"),
    ("sch_retail_receipt_v1", "store_name", "string"),
    ("sch_retail_receipt_v1", "receipt_number", "id"),
    ("sch_retail_receipt_v1", "receipt_date", "date"),
    ("sch_retail_receipt_v1", "payment_method", "string"),
    ("sch_retail_receipt_v1", "subtotal_amount", "money"),
    ("sch_retail_receipt_v1", "tax_amount", "money"),
    ("sch_retail_receipt_v1", "total_amount", "money"),
    ("sch_bank_statement_v1", "account_holder", "string"),
    ("sch_bank_statement_v1", "account_number", "id"),
    ("sch_bank_statement_v1", "statement_period", "string"),
    ("sch_bank_statement_v1", "opening_balance", "money"),
    ("sch_bank_statement_v1", "closing_balance", "money"),
    ("sch_resume_v1", "candidate_name", "string"),
    ("sch_resume_v1", "email", "email"),
    ("sch_resume_v1", "phone", "phone"),
    ("sch_resume_v1", "summary", "text"),
    ("sch_resume_v1", "skills", "text"),
    ("sch_resume_v1", "education", "text"),
    ("sch_resume_v1", "experience", "text"),
    ("sch_resume_v1", "projects", "text"),
    ("sch_certificate_v1", "recipient_name", "string"),
    ("sch_certificate_v1", "credential_title", "string"),
    ("sch_certificate_v1", "issuing_organization", "string"),
    ("sch_certificate_v1", "issue_date", "date"),
    ("sch_certificate_v1", "certificate_id", "id"),
    ("sch_contract_v1", "primary_parties", "text"),
    ("sch_contract_v1", "effective_date", "date"),
    ("sch_contract_v1", "expiration_date", "date"),
    ("sch_contract_v1", "governing_law", "string"),
    ("sch_contract_v1", "terms_summary", "text"),
    ("sch_delivery_challan_v1", "challan_number", "id"),
    ("sch_delivery_challan_v1", "challan_date", "date"),
    ("sch_delivery_challan_v1", "sender_name", "string"),
    ("sch_delivery_challan_v1", "receiver_name", "string"),
    ("sch_delivery_challan_v1", "vehicle_number", "string"),
    ("sch_medical_report_v1", "patient_name", "string"),
    ("sch_medical_report_v1", "patient_age_gender", "string"),
    ("sch_medical_report_v1", "referring_doctor", "string"),
    ("sch_medical_report_v1", "report_date", "date"),
    ("sch_medical_report_v1", "diagnosis", "text"),
    ("sch_insurance_v1", "policy_number", "id"),
    ("sch_insurance_v1", "policy_holder", "string"),
    ("sch_insurance_v1", "start_date", "date"),
    ("sch_insurance_v1", "end_date", "date"),
    ("sch_insurance_v1", "sum_insured", "money"),
    ("sch_insurance_v1", "premium_amount", "money"),
    ("sch_id_document_v1", "document_id_number", "id"),
    ("sch_id_document_v1", "full_name", "string"),
    ("sch_id_document_v1", "date_of_birth", "date"),
    ("sch_id_document_v1", "address", "text"),
    ("sch_id_document_v1", "expiry_date", "date"),
    ("sch_expense_report_v1", "employee_name", "string"),
    ("sch_expense_report_v1", "employee_id", "id"),
    ("sch_expense_report_v1", "report_date", "date"),
    ("sch_expense_report_v1", "total_amount", "money"),
    ("sch_application_form_v1", "applicant_name", "string"),
    ("sch_application_form_v1", "application_id", "id"),
    ("sch_application_form_v1", "submission_date", "date"),
    ("sch_application_form_v1", "form_summary", "text"),
)
#: Fields whose canonical key isn't that of an alias of their name.
KEYS = (
    ("sch_purchase_order_v1", "buyer_name", None),
    ("sch_certificate_v1", "recipient_name", "person.full_name"),
    ("sch_contract_v1", "effective_date", "document.date"),
    ("sch_delivery_challan_v1", "challan_date", "document.date"),
    ("sch_medical_report_v1", "report_date", "document.date"),
    ("sch_insurance_v1", "policy_number", "document.reference_number"),
    ("sch_insurance_v1", "policy_holder", "person.full_name"),
    ("sch_id_document_v1", "document_id_number", "document.reference_number"),
    ("sch_expense_report_v1", "employee_name", "person.full_name"),
    ("sch_expense_report_v1", "report_date", "document.date"),
    ("sch_application_form_v1", "application_id", "document.reference_number"),
    ("sch_application_form_v1", "submission_date", "document.date"),
)
#: Schema, table, columns.
TABLES = (
    ("sch_commercial_invoice_v1", "items", ("description", "quantity", "unit_price", "amount")),
    ("sch_purchase_order_v1", "items", ("item_name", "quantity", "unit_price", "total")),
    ("sch_retail_receipt_v1", "items", ("item_name", "qty", "price")),
    ("sch_bank_statement_v1", "transactions", ("date", "description", "debit", "credit", "balance")),
    ("sch_delivery_challan_v1", "items", ("description", "quantity", "unit")),
    ("sch_medical_report_v1", "test_results", ("test_name", "result_value", "unit", "reference_interval")),
    ("sch_expense_report_v1", "expenses", ("date", "category", "description", "amount")),
)
#: Schema, rule, first and further arguments.
RULES = (
    ("sch_commercial_invoice_v1", "sum_equals", "total_amount", ("items.amount", "tax_amount")),
    ("sch_purchase_order_v1", "sum_equals", "total_amount", ("items.total",)),
    ("sch_bank_statement_v1", "running_balance", "opening_balance", ("debit", "credit", "balance")),
    ("sch_contract_v1", "date_order", "effective_date", ("expiration_date",)),
    ("sch_insurance_v1", "date_order", "start_date", ("end_date",)),
    ("sch_expense_report_v1", "sum_equals", "total_amount", ("expenses.amount",)),
)
#: Words that a user may give for a type, and the type.
TYPE_NAMES = (
    ("bill", "invoice"),
    ("commercial_invoice", "invoice"),
    ("tax_invoice", "invoice"),
    ("po", "purchase_order"),
    ("retail_receipt", "receipt"),
    ("store_receipt", "receipt"),
    ("restaurant", "receipt"),
    ("travel", "receipt"),
    ("hotel", "receipt"),
    ("statement", "bank_statement"),
    ("bank_stmt", "bank_statement"),
    ("cv", "resume"),
    ("curriculum_vitae", "resume"),
    ("student_document", "certificate"),
    ("academic_record", "certificate"),
    ("marksheet", "certificate"),
    ("transcript", "certificate"),
    ("diploma", "certificate"),
    ("agreement", "contract"),
    ("nda", "contract"),
    ("mou", "contract"),
    ("challan", "delivery_challan"),
    ("dispatch_slip", "delivery_challan"),
    ("lab_report", "medical_report"),
    ("health_report", "medical_report"),
    ("pathology_report", "medical_report"),
    ("insurance_policy", "insurance"),
    ("insurance_document", "insurance"),
    ("policy", "insurance"),
    ("id_card", "id_document"),
    ("passport", "id_document"),
    ("driver_license", "id_document"),
    ("driving_licence", "id_document"),
    ("national_id", "id_document"),
    ("expense_claim", "expense_report"),
    ("reimbursement", "expense_report"),
    ("application", "application_form"),
    ("form", "application_form"),
)


def schemas(spark: SparkSession) -> DataFrame:
    """schema_id, name, family, version, fingerprint, is_active, origin, and the fields with their canonical keys, tables and rules.

    A field's canonical key is the one in KEYS, else that of its alias in ALIASES.
    """
    keys, own = {alias: key for key, alias, _, _ in ALIASES}, {(s, k): key for s, k, key in KEYS}
    rows = []
    for i, name, family in SCHEMAS:
        fields = [(k, kind, own[i, k] if (i, k) in own else keys.get(k)) for s, k, kind in FIELDS if s == i]
        rows.append((i, name, family, 1, None, True, "template", fields, [(t, list(c)) for s, t, c in TABLES if s == i], [(r, a, list(b)) for s, r, a, b in RULES if s == i]))
    return spark.createDataFrame(rows, "schema_id string, name string, family string, version int, fingerprint string, is_active boolean, origin string, fields array<struct<key:string,data_type:string,canonical_key:string>>, tables array<struct<key:string,columns:array<string>>>, rules array<struct<rule:string,target:string,terms:array<string>>>")


def aliases(spark: SparkSession) -> DataFrame:
    """canonical_key, alias, data_type, family."""
    return spark.createDataFrame(list(ALIASES), "canonical_key string, alias string, data_type string, family string")
