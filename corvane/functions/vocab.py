"""Fixed values of the domain: keyword lists, ontology terms, relation rules, weights.

Everything here must equal the public definition for results to agree, so it is stated plainly.
"""

from __future__ import annotations


def _lines(text: str) -> list[str]:
    return [x.strip() for x in text.strip().split("\n") if x.strip()]


def _commas(text: str) -> list[str]:
    return [x.strip() for x in text.replace("\n", " ").split(",") if x.strip()]


# Section headings by kind, in order of priority.
SECTION_HEADERS = {
    "responsibilities": _commas("""detailed responsibilities, responsibilities, job responsibilities, key responsibilities, roles & responsibilities,
        roles and responsibilities, role responsibilities, duties, role overview, what you will do, your responsibilities, scope of work, primary responsibilities"""),
    "skills": _commas("""skill requirements, required skills, mandatory skills, technical skills, must have skills, must-have skills, skills required, skills,
        qualifications, eligibility, requirements, what we are looking for, what you need, what you bring, minimum qualifications, basic qualifications"""),
    "other": _commas("""other requirements, additional requirements, preferred skills, preferred qualifications, nice to have, good to have,
        additional information, bonus, plus, would be a plus, would be an advantage, added advantage"""),
}

# Names a markdown section may have, by kind; the first that is not empty counts.
SECTION_ALIASES = {
    "responsibilities": _commas("""Detailed Responsibilities, Responsibilities, Job Responsibilities, Key Responsibilities, Roles & Responsibilities,
        Roles and Responsibilities, Role Responsibilities, Duties, Role Overview"""),
    "skills": _commas("""Skill Requirements, Required Skills, Mandatory Skills, Technical Skills, Must Have Skills, Must-Have Skills, Skills Required, Skills,
        Qualifications, Eligibility, Requirements, Minimum Qualifications"""),
    "other": _commas("""Other Requirements, Additional Requirements, Preferred Skills, Preferred Qualifications, Nice to Have, Good to Have, Additional Information"""),
}

# Patterns of lines that are headings inside a section (matched against the whole line).
SUB_HEADERS = _lines(r"""
must\s*have
educational\s*(qualifications?|requirements?)
experience
technical\s*skills?
good\s*to\s*have
nice\s*to\s*have
preferred
soft\s*skills?
key\s*skills?
mandatory\s*skills?
""")
LABEL_LINE = "[a-z ]{3,40}:"

# Keywords of the bullet classes, in order of priority. Substrings, false positives included.
BULLET_KEYWORDS = {
    "certification": _commas("""aws certified, azure certified, google professional, google cloud certified, pmp, itil, scrum master, oracle certified, cisco,
        comptia, ceh, cissp, cism, cisa, six sigma""") + ["safe "] + _commas("""togaf, rhce, rhcsa, ccna, ccnp, ccie, gcp certified, prince2, certificate,
        certification, certified"""),
    "education": _commas("""bachelor, master, degree, graduate, phd, b.tech, m.tech, b.e., m.e, bsc, msc, mba, bca, mca, b.sc, m.sc, b.com, education,
        qualification, diploma, undergraduate, postgraduate, university, college, 12th, 10th, computer science, engineering degree, information technology degree"""),
    "experience": _commas("experience, years") + [" yrs"] + _commas("""minimum, worked, working, at least, hands-on, prior experience, track record,
        background in, exposure to, proven"""),
    "soft_skill": _commas("""communication, leadership, teamwork, team player, analytical, adaptability, adaptable, collaboration, collaborative, problem solving,
        problem-solving, critical thinking, interpersonal, time management, presentation, attention to detail, self-motivated, multitasking, creativity, creative,
        empathy, conflict resolution, organizational, proactive, detail-oriented, work ethic, ownership, accountability, initiative, positive attitude,
        self-starter, verbal, written communication, stakeholder management, cross-functional, flexibility, willingness"""),
    "technology": _commas("""python, java, javascript, typescript, c++, c#, golang, rust, scala, kotlin, swift, ruby, php, matlab, sql, nosql, graphql, html, css,
        react, angular, vue, next.js, node.js, spring, spring boot, springboot, django, flask, fastapi, tensorflow, pytorch, keras, scikit-learn, sklearn, pandas,
        numpy, spark, hadoop, kafka, flink, airflow, mlflow, langchain, llamaindex, hugging face, transformers, bert, gpt, llm, generative ai, gen ai,
        machine learning, deep learning, nlp, computer vision, reinforcement learning, aws, azure, gcp, google cloud, microservices, rest api, restful, grpc, soap,
        pl/sql, oracle, mysql, postgresql, mongodb, redis, elasticsearch, opensearch, neo4j, cassandra, dynamodb, snowflake, databricks, power bi, tableau, looker,
        linux, unix, windows server, shell scripting, bash, terraform, ansible, puppet, chef, selenium, appium, junit, mockito, pytest"""),
    "tool": _commas("""docker, kubernetes, k8s, jenkins, gitlab, github, bitbucket, jira, confluence, servicenow, remedy, splunk, datadog, prometheus, grafana, elk,
        kibana, logstash, sonarqube, nexus, artifactory, helm, istio, ci/cd, devops, git, svn, postman, swagger, intellij, eclipse, visual studio, vs code, maven,
        gradle, npm, yarn, webpack, xcode, android studio, figma, sketch, adobe, sap, salesforce, workday, ms office, microsoft office, microsoft teams, slack, zoom,
        agile, scrum, kanban, waterfall, itsm, itil, pagerduty, opsgenie, new relic, dynatrace, ansible, puppet, chef"""),
    "preferred_skill": _commas("""preferred, is a plus, would be a plus, nice to have, good to have, advantageous, desirable, added advantage, beneficial, optional,
        exposure to, familiarity with, knowledge of, experience with"""),
}
#: Short technology names that count only as whole words.
TECHNOLOGY_WORDS = ["r", "c", "go"]

# Terms of the ontology.
TERMS = {
    "ProgrammingLanguage": _commas("python, java, javascript, typescript, c++, c#, kotlin, scala, swift, sql, tcl"),
    "Framework": _commas("""fastapi, django, flask, spring boot, springboot, spring, react, react.js, angular, vue, vuejs, next.js, nextjs, express.js, express,
        node.js, node, flutter, react native, tailwind, tailwindcss, asp.net mvc"""),
    "Database": _commas("postgresql, postgres, mysql, mongodb, redis, sql server, ms sql, snowflake, oracle, google bigquery, azure databricks"),
    "CloudPlatform": _commas("aws, amazon web services, azure, microsoft azure, gcp, google cloud, aws paas, azure devops"),
    "Tool": _commas("""docker, kubernetes, git, postman, jenkins, terraform, ansible, jira, selenium, airflow, apache spark, spark, amazon glue,
        azure data factory (adf), power bi, tableau, xcode, android studio, servicenow, remedy"""),
    "Certification": _commas("itil foundation, python programming certification, aws certified, azure certified, scrum master, pmp"),
    "SoftSkill": _commas("""communication, problem solving, teamwork, leadership, collaboration, stakeholder management, time management, adaptability,
        analytical thinking, research, advising"""),
    "Role": _commas("""backend developer, python backend developer, software engineer, full stack developer, frontend developer, devops engineer, data engineer,
        data analyst, qa engineer, automation tester, test manager, technical lead, tech lead, project manager, business analyst, regulatory affairs manager,
        compliance specialist, administrator, support engineer"""),
}
ROLE_WORDS = _commas("developer, engineer, manager, analyst, lead, architect")
EDUCATION_WORDS = _commas("degree, bachelor, master")

# Technology stacks.
STACKS = {
    "python backend": {"role": "backend developer", "languages": ["python"], "frameworks": ["fastapi", "django", "flask"], "tools": ["docker", "git", "postman"], "databases": ["postgresql", "mysql", "mongodb", "redis"], "cloud": ["aws", "azure"], "concepts": ["rest api", "microservices"]},
    "java backend": {"role": "backend developer", "languages": ["java"], "frameworks": ["spring boot", "spring"], "tools": ["docker", "git", "postman"], "databases": ["postgresql", "mysql", "sql server"], "cloud": ["aws", "azure"], "concepts": ["rest api", "microservices"]},
    "frontend": {"role": "frontend developer", "languages": ["javascript", "typescript"], "frameworks": ["react", "react.js", "angular", "vue", "next.js"], "tools": ["git", "postman"], "concepts": ["rest api"]},
    "devops": {"role": "devops engineer", "tools": ["docker", "kubernetes", "jenkins", "terraform", "ansible", "git"], "cloud": ["aws", "azure", "gcp"], "concepts": ["ci/cd", "cloud"]},
    "data engineering": {"role": "data engineer", "languages": ["python", "sql"], "tools": ["apache spark", "spark", "airflow", "amazon glue", "azure data factory (adf)"], "databases": ["snowflake", "google bigquery", "postgresql", "ms sql"], "cloud": ["aws", "azure", "gcp"]},
    "qa automation": {"role": "qa engineer", "languages": ["java", "python"], "tools": ["selenium", "postman", "jira", "git"], "concepts": ["automation testing", "regression testing"]},
}
PARTS = {"role": "Role", "languages": "ProgrammingLanguage", "frameworks": "Framework", "tools": "Tool", "databases": "Database", "cloud": "CloudPlatform", "concepts": "Skill"}

# Fixed values: (source type, target type, relation, confidence).
RULES = [
    ("ProgrammingLanguage", "Framework", "USES_FRAMEWORK", 0.92), ("Framework", "ProgrammingLanguage", "FRAMEWORK_FOR_LANGUAGE", 0.92),
    ("Framework", "Skill", "SPECIALIZES_IN", 0.86), ("Skill", "Framework", "SUPPORTED_BY_FRAMEWORK", 0.78), ("Framework", "Tool", "USES_TOOL", 0.78),
    ("Tool", "Framework", "SUPPORTS_FRAMEWORK", 0.72), ("ProgrammingLanguage", "Database", "USES_DATABASE", 0.72), ("Database", "ProgrammingLanguage", "DATABASE_USED_WITH", 0.70),
    ("ProgrammingLanguage", "Tool", "USES_TOOL", 0.70), ("Tool", "ProgrammingLanguage", "TOOL_FOR_LANGUAGE", 0.70), ("Tool", "Database", "DEPLOYS_WITH_DATABASE", 0.62),
    ("ProgrammingLanguage", "CloudPlatform", "USES_CLOUD", 0.64), ("Tool", "CloudPlatform", "DEPLOYS_TO_CLOUD", 0.68), ("Role", "ProgrammingLanguage", "MATCHES_ROLE", 0.80),
    ("Role", "Framework", "MATCHES_ROLE", 0.78), ("Role", "Tool", "MATCHES_ROLE", 0.68), ("Role", "Database", "MATCHES_ROLE", 0.66), ("Role", "Skill", "SPECIALIZES_IN", 0.74),
]
#: Pairs of parts whose edges exist only where the stack names a language.
NEEDS_LANGUAGE = [("Framework", "Skill"), ("Skill", "Framework")]

# Terms and places that a typed query is searched for.
QUERY_SKILLS = _commas("""python, java, javascript, typescript, react, angular, node, fastapi, django, flask, spring, spring boot, springboot, sql, mysql, postgresql,
    mongodb, redis, docker, kubernetes, aws, azure, gcp, devops, ci/cd, selenium, rest, rest api, microservices, machine learning, ml, data science, snowflake,
    databricks, spark, airflow, git, linux, terraform""")  # fmt: skip
QUERY_LANGUAGES = _commas("python, java, javascript, typescript")
QUERY_FRAMEWORKS = _commas("fastapi, django, flask, react, angular, spring, spring boot, springboot")
QUERY_TOOLS = _commas("docker, kubernetes, git, terraform, selenium")
QUERY_CITIES = _commas("pune, bengaluru, bangalore, chennai, hyderabad, noida, mumbai, delhi, gurgaon, gurugram, kolkata, texas, virginia, manila, taguig")
QUERY_ROLES = _commas("developer, engineer, architect, lead, manager")
JOB_WORDS = _commas("job, opening, requirement, hiring, jd, description")
PROFILE_WORDS = _commas("candidate, profile, resume, developer, engineer")

# Seeds and modifiers of the generated benchmark.
BENCHMARK_SEEDS = [
    ("profile_search", "python backend developer", ["python", "backend", "developer", "fastapi"]),
    ("profile_search", "java spring boot developer", ["java", "spring boot", "developer"]),
    ("profile_search", "devops engineer cloud ci cd", ["devops", "cloud", "ci/cd", "aws"]),
    ("profile_search", "qa automation tester selenium", ["qa", "automation", "selenium"]),
    ("profile_search", "data analyst sql power bi", ["data", "sql", "power bi"]),
    ("profile_search", "regulatory affairs compliance specialist", ["regulatory affairs", "compliance", "fda"]),
    ("job_search", "backend jobs in pune", ["backend", "pune", "developer"]),
    ("job_search", "servicenow technical lead", ["servicenow", "technical lead", "itbm"]),
    ("job_search", "test manager bengaluru", ["test manager", "bengaluru", "selenium"]),
    ("job_search", "data engineer jobs python sql", ["data engineer", "python", "sql"]),
    ("jd_search", "python developer responsibilities", ["python", "developer", "backend"]),
    ("jd_search", "qa engineer test cases regression", ["qa", "test cases", "regression"]),
    ("jd_search", "project manager stakeholder delivery", ["project manager", "stakeholder", "delivery"]),
    ("jd_search", "servicenow developer requirements", ["servicenow", "developer", "workflow"]),
    ("jd_search", "java microservices job description", ["java", "microservices", "developer"]),
]
BENCHMARK_MODIFIERS = ["", "with 0 to 2 years", "senior", "in pune", "in bengaluru", "remote", "full time", "with docker", "with sql", "with cloud"]
BENCHMARK_SIZE = 120

#: Dataset searched for each intent.
INTENT_SOURCE = {"profile_search": "profile", "job_search": "demand", "jd_search": "jd"}

# Retrieval and ranking constants.
BM25_K1, BM25_B = 1.5, 0.75
RRF_K = 60
DEPTH, POOL, FINAL = 50, 20, 10
MIN_CONFIDENCE, EXPANSION_LIMIT = 0.60, 5
RRF_WEIGHT, GRAPH_WEIGHT, CE_WEIGHT = 0.65, 0.20, 0.15
REL_WEIGHT, TEXT_WEIGHT = 0.35, 0.65
METRIC_KS = (5, 10, 20)

# Relation and confidence of a document's entity, by entity type and by field.
CANDIDATE_REL = {"Framework": "USES_FRAMEWORK", "Tool": "USES_TOOL", "Database": "USES_DATABASE", "CloudPlatform": "USES_CLOUD", "Certification": "CERTIFIED_IN"}
DEMAND_REL = {"Framework": "REQUIRES_FRAMEWORK", "Tool": "REQUIRES_TOOL", "Database": "REQUIRES_DATABASE", "CloudPlatform": "REQUIRES_CLOUD", "Certification": "REQUIRES_CERTIFICATION"}
JD_CONFIDENCE = {"must_have_skills": 0.90, "preferred_skills": 0.76, "technologies": 0.82, "tools": 0.82, "certifications": 0.72, "education": 0.70}
