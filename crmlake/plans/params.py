"""Fixed request parameters of the registered queries.

The registered queries replay representative requests (a search term, a
facet value, a page number, a reference date) over the whole tables; the
oracle SQL uses the same values. Dates: orders/lineitem span 1995-2001 and
events span January 2024 in the test tables.
"""

AS_OF_ORDERS = "2001-08-01 00:00:00"
AS_OF_EDU = "2001-08-15 00:00:00"
MONTHS = 12

SEARCH_CUSTOMER = "#00000012"      # matches customer names ...#00000012x
SEARCH_COMPANY = "NATION_1"        # matches NATION_1 and NATION_10..19
SEGMENT = "BUILDING"
STAGE = "Proposal"
EVENT_TYPE = "click"
TICKET_STATUS = "Open"
TICKET_PRIORITY = "High"
ACTION = "LOGIN"
SEARCH_LOG = '"k": 1'
SUPPORT_DEPARTMENT = "ASIA"        # bound departments are region names
TEACHING_DEPARTMENT = "EUROPE"
STUDENT_STATUS = "Studying"
ENROLLMENT_STATUS = "Confirmed"
CLASS_STATUS = "Ongoing"
COURSE_CATEGORY = "Kỹ năng"
SEARCH_CLASS = "NATION_2"
SEARCH_COURSE = "A"

PAGE = 3
DEEP_PAGE = 250
PAST_THE_END = 1_000_000  # a page number beyond every list

CUSTOMER_KEY = 17          # keys of the point lookups
STUDENT_KEY = 25
SEARCH_FOLDED = "nation_1"         # as SEARCH_COMPANY, in lower case
CATEGORY_FOLDED = "ky nang"        # COURSE_CATEGORY without marks
SEARCH_FILES = 16                  # files of the stored customers that the search index covers
BUCKETS = 8
KEYS_PER_FOLDER = 500
