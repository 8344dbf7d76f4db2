"""Schemas of the three raw tables (fixed column names and order)."""

from __future__ import annotations

APPLICATIONS = """
    customer_id string, loan_id string, application_date string, age int, gender string, marital_status string,
    education_level string, num_dependents int, residential_status string, time_at_current_address_months int,
    pincode string, is_urban_residence int, employment_type string, time_at_current_job_months int,
    monthly_gross_income double, declared_monthly_expenses double, loan_amount_requested double, loan_term_months int,
    loan_purpose string, emi_requested double, collateral_flag int, collateral_value double,
    loan_to_value_ratio double, other_emi_declared double, debt_service_ratio_declared double,
    has_credit_history int, is_default int
"""

CREDIT_ACCOUNTS = """
    customer_id string, credit_score int, account_id string, account_open_date string, account_type string,
    sanctioned_limit double, current_balance double, dpd_status string, max_dpd_past_24m int, num_30_dpd_last_6m int,
    num_90_dpd_last_12m int, num_defaults_total int, num_settled_total int, account_status string, inquiry_date string
"""

TRANSACTIONS = """
    customer_id string, transaction_id string, transaction_date string, amount double, type string,
    description string, category string
"""
